from pyspark.sql import functions as F

from maskwright.functions import detectors, sql
from maskwright.operators import pages, textmap
from maskwright.sources.rules import RuleTable, try_pattern


def state(rules, version=None):
    return [(r.id, r.pattern, r.enabled) for r in rules.rules(version).orderBy("position").collect()]


def rule(i, pattern, kind="keyword", **more):
    return {"id": i, "name": f"n {i}", "type": kind, "pattern": pattern, **more}


def test_versions_of_a_table(spark, tmp_path):
    rules = RuleTable(spark, f"file://{tmp_path}/rules")
    assert rules.version() == 0 and state(rules) == []
    assert rules.save([rule("a", "alpha"), rule("b", "beta.*"), rule("c", "[0-9]{3}", "regex", enabled=False), rule("d", "x"), rule("e", "(a+)+", "regex"), rule("a", "Alpha2")]) == 1
    first = [("a", "Alpha2", True), ("b", "beta.*", True), ("c", "[0-9]{3}", False)]
    assert state(rules) == first
    assert rules.enable(["b", "zz"], False) == 2 and rules.delete(["a", "zz"]) == 3 and rules.save([rule("a", "again")]) == 4 and rules.save([rule("b", "beta2")]) == 5
    assert state(rules, 0) == [] and state(rules, 1) == first and state(rules, 2) == [first[0], ("b", "beta.*", False), first[2]]
    assert state(rules, 3) == [("b", "beta.*", False), first[2]] and state(rules, 4) == [("b", "beta.*", False), first[2], ("a", "again", True)]
    assert state(rules) == [("b", "beta2", True), first[2], ("a", "again", True)]
    # Another writer has taken the next number: this one takes the one after it. A folder without a commit is nothing.
    other = RuleTable(spark, f"file://{tmp_path}/rules")
    taken = other.version
    other.version = lambda: 4 if not hasattr(other, "_asked") and not setattr(other, "_asked", True) else taken()
    assert other.enable(["c"]) == 6 and state(rules)[1] == ("c", "[0-9]{3}", True)
    assert rules.history().where("op = 'switch'").count() == 3


def test_matches_of_a_version(spark, tmp_path):
    rules = RuleTable(spark, f"file://{tmp_path}/rules")
    rules.save([rule("k", "a.b"), rule("n", "[0-9]{3}", "regex")])
    rows = spark.createDataFrame([(1, "A.B xa.bA.b axb 1234"), (None, "567 a.b"), (2, None), (3, "")], "id long, t string")
    got = sorted((r.id or 0, r.rule_id, r.text, r.start) for r in rules.matches(rows, ["id"], "t").collect())
    assert got == [(0, "k", "a.b", 4), (0, "n", "567", 0), (1, "k", "A.B", 0), (1, "k", "A.b", 8), (1, "k", "a.b", 5), (1, "n", "123", 16)]
    rules.enable(["k", "n"], False)
    assert rules.matches(rows, ["id"], "t").count() == 0 and rules.matches(rows, ["id"], "t", version=1).count() == 6
    assert try_pattern(spark, "[0-9]+", "a1 b22") == (True, ["1", "22"]) and try_pattern(spark, "A.", "xa. a.", "keyword") == (True, ["a.", "a."])
    assert try_pattern(spark, "(a+)+b", "aab") == (False, []) and try_pattern(spark, "[", "a") == (False, [])


def test_sql_functions_equal_the_detectors(spark):
    made = sql.register(spark, ["email", "ssn", "person_name", "env_secret", "api_token"])
    assert made == ["detect_email", "detect_ssn", "detect_person_name", "detect_env_secret", "detect_api_token"]
    texts = ["mail a.one@corp.com and a.one@corp.com", "ssn: 123-45-6789 or 123456789", "Customer name: Maya Stone", "API_TOKEN='abc12345' pwd=x", None, "", "it's 'quoted' \\ back \"x\" é日", "key sk_live_abcdefghijklmnopqrstuvwx"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows.createOrReplaceTempView("sql_rows")
    for kind in ("email", "ssn", "person_name", "env_secret", "api_token"):
        got = {tuple(r) for r in spark.sql(f"SELECT id, d.text, d.span, d.start FROM sql_rows, LATERAL detect_{kind}(t) d").collect()}
        want = {(r.id, r.text, r.span, r.start) for r in detectors.detect(rows, ["id"], "t", only=[kind]).collect()}
        assert got == want and got
    spark.catalog.dropTempView("sql_rows")


def test_operators_as_sql_text():
    quoted = sql.as_sql(F.when((F.col("a") > 1) & ~F.col("b").rlike("x>(y) and(z)"), F.col("a") + 1))
    assert "`and`(`>`(a, 1)" in quoted and "'x>(y) and(z)'" in quoted and "`+`(a, 1)" in quoted


def test_ranges_and_runs_of_joined_texts(spark):
    words = [(1, 0, 0, "ab", 0.0, 20.0), (1, 0, 1, "cd-7", 23.0, 63.0), (1, 0, 2, "x9", 70.0, 90.0), (1, 1, 0, "long", 0.0, 40.0), (None, 0, 0, "null", 0.0, 40.0)]
    df = spark.createDataFrame(words, "page long, line_index int, word_index int, text string, x0 double, x1 double").withColumns({"y0": F.col("line_index") * 20.0, "y1": F.col("line_index") * 20.0 + 12})
    texts = textmap.joined_text(df, ["page"])
    rows = {r.page: r for r in texts.collect()}
    assert rows[1].text == "ab cd-7 x9 long" and rows[None].text == "null"
    assert [(w.start, w.end, w.line_index, w.run) for w in rows[1].spans] == [(0, 2, 0, 1), (3, 7, 0, 1), (8, 10, 0, 1), (11, 15, 1, 1)]
    for a, b, want in ((0, 2, ["ab"]), (1, 4, ["ab", "cd"]), (2, 3, []), (0, 99, ["ab", "cd", "x9", "lo"]), (10, 12, ["lo"]), (5, 5, []), (50, 60, [])):
        got = texts.where("page = 1").select(textmap.words_in_range(F.col("spans"), F.lit(a), F.lit(b)).alias("w")).first().w
        assert [w["_t"][:2] for w in got] == want, (a, b)
    matches = spark.createDataFrame([(1, "AB CD7", "api_token", 0), (None, "nul", "x", 0), (1, "l", "x", 1), (1, " ", "x", 0)], "page long, text string, type string, occurrence int")
    got = sorted((r.page or 0, r.text, r.line_index, r.x0, r.x1, r.n_words) for r in textmap.match_boxes(matches, texts, ["page"]).collect())
    assert got == [(0, "nul", 0, 0.0, 40.0, 1), (1, "AB CD7", 0, 0.0, 90.0, 3)]


def test_free_words_gather_around_a_moving_middle(spark):
    rows = [(1, k, f"w{k}", 10.0 * k, float(y), 10.0 * k + 8, float(y) + 10) for k, y in enumerate([0, 4, 8, 30, 33, 100])] + [(None, 0, "n", 0.0, 0.0, 5.0, 5.0), (1, 9, " ", 0.0, 0.0, 5.0, 5.0)]
    words = spark.createDataFrame(rows, "page long, word_index int, text string, x0 double, y0 double, x1 double, y1 double")
    lines = {(r.page, r.line_index): r.text for r in textmap.lines_of_words(textmap.visual_groups(words, ["page"]), ["page"]).collect()}
    assert lines == {(None, 0): "n", (1, 0): "w0 w1", (1, 1): "w2", (1, 2): "w3 w4", (1, 3): "w5"} or lines[(1, 0)].startswith("w0 w1")
    assert pages.that_hold(words.withColumn("line_index", F.lit(0)), ["page"], F.col("text") == "n").count() == 1
