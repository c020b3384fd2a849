import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import detectors, fixed
from maskwright.operators import masking, pages, review, spatial
from maskwright.sources.tables import document_lines, files

K = ["doc_id", "page"]


def lines(spark, *texts, x0=None):
    docs = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    return pages.lay_out(docs)


def test_words_and_candidates(spark):
    words = pages.words_of(lines(spark, "one  two three", "four"), K)
    got = [(r.line_index, r.word_index, r.text, r.start, r.x0, r.x1) for r in words.orderBy("line_index", "word_index").collect()]
    assert got == [(0, 0, "one", 0, 10.0, 46.0), (0, 1, "two", 5, 70.0, 106.0), (0, 2, "three", 9, 118.0, 178.0), (1, 0, "four", 0, 10.0, 58.0)]
    runs = {r.spaced for r in pages.candidates(words, K).collect()}
    assert runs == {"one", "two", "three", "one two", "two three", "one two three", "four"}
    far = words.withColumns({c: F.when(F.col("text") == "three", F.col(c) + 500).otherwise(F.col(c)) for c in ("x0", "x1")})
    assert "two three" not in {r.spaced for r in pages.candidates(far, K).collect()}
    assert {r.n for r in pages.candidates(words, K, most=2).groupBy().agg(F.max("n_words").alias("n")).collect()} == {2}


def test_wrapped_windows(spark):
    w = pages.wrapped_windows(lines(spark, "alpha beta", "gamma", "delta.", "end"), K).orderBy("line_index").collect()
    assert [(r.line_index, r.n_lines, r.text) for r in w] == [(0, 3, "alpha beta gamma delta."), (1, 2, "gamma delta.")]
    gap = lines(spark, "alpha", "", "", "beta")
    assert pages.wrapped_windows(gap, K).count() == 0


def test_wrapped_values(spark):
    page = lines(spark, "pay TR33 0006 1005", "1978 6457 8413 26 soon", "Authorization: Bearer abcdef", "ghijklmnop123456")
    (r,) = pages.wrapped_ibans(page, K).collect()
    assert r.compact == "TR330006100519786457841326" and r.text == "TR33 0006 1005 1978 6457 8413 26"
    parts = pages.wrapped_bearer_tokens(page, K).orderBy("line_index").collect()
    assert [(p.line_index, p.span) for p in parts] == [(2, "Bearer abcdef"), (3, "ghijklmnop123456")]
    head = page.limit(1).select(*K, F.lit("TR33 0006 1005").alias("text"), F.lit("iban").alias("rule_id"))
    assert pages.without_iban_heads(head, pages.wrapped_ibans(page, K), K).count() == 0


def test_seed_phrases(spark):
    vocabulary = [f"word{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26)]
    table = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    texts = [(1, "x " + " ".join(vocabulary[:12]) + " y"), (2, " ".join(vocabulary[:24])), (3, " ".join(vocabulary[:3] * 4)), (4, " ".join(vocabulary[:11])), (5, None)]
    rows = pages.seed_phrases(spark.createDataFrame(texts, "id int, text string"), ["id"], table).orderBy("id").collect()
    assert [(r.id, r.start_word, len(r.text.split())) for r in rows] == [(1, 1, 12), (2, 0, 24)]


def test_keys_over_lines(spark):
    page = lines(spark, "see -----BEGIN RSA PRIVATE KEY-----", "MII" + "a" * 30, "x", "-----END RSA PRIVATE KEY----- done", "after")
    got = [(r.line_index, r.start, r.span) for r in pages.private_keys(page, K).orderBy("line_index").collect()]
    assert got == [(0, 4, "-----BEGIN RSA PRIVATE KEY-----"), (1, 0, "MII" + "a" * 30), (2, 0, "x"), (3, 0, "-----END RSA PRIVATE KEY-----")]
    endless = lines(spark, "-----BEGIN EC PRIVATE KEY-----", *[f"line {k}" for k in range(60)])
    assert [r.line_index for r in pages.private_keys(endless, K).orderBy("line_index").collect()] == list(range(41))
    broken = lines(spark, "-- BEG1N RSA PR1VATE KEY", "A" * 30, "B" * 30, "-----END", "plain words", "C" * 30)
    assert [r.line_index for r in pages.private_keys(broken, K).orderBy("line_index").collect()] == [0, 1, 2, 3]
    public = lines(spark, "-----BEGIN PUBLIC KEY-----", "A" * 30, "B" * 30)
    assert pages.private_keys(public, K).count() == 0


def test_fragments(spark):
    words = pages.words_of(lines(spark, "see 2001 db8:: 1 end", "fe80::1 12"), K)
    got = pages.fragments(words, K).orderBy("line_index").collect()
    assert [(r.line_index, r.text) for r in got][0] == (0, "2001:db8::1") and got[1].text.startswith("fe80::1")
    apart = words.withColumns({c: F.when(F.col("text") == "db8::", F.col(c) + 500).otherwise(F.col(c)) for c in ("x0", "x1")})
    assert "2001:db8::1" not in {r.text for r in pages.fragments(apart, K).collect()}


def test_seed_phrases_over_lines(spark):
    vocabulary = [f"word{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26)]
    table = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    page = lines(spark, "x " + " ".join(vocabulary[:7]), " ".join(vocabulary[7:12]) + " y", ".", " ".join(vocabulary[:12]))
    got = {(r.line_index, r.span) for r in pages.seed_phrase_lines(page, K, table).collect()}
    assert got == {(0, " ".join(vocabulary[:7])), (1, " ".join(vocabulary[7:12])), (3, " ".join(vocabulary[:12]))}


def slow_cover(text, spans):
    out = list(text)
    for value in spans:
        at = text.find(value)
        while at >= 0:
            out[at : at + len(value)] = "█" * len(value)
            at = text.find(value, at + len(value))
    return "".join(out)


def test_every_place_of_random_lines_is_covered(spark):
    """Values between words and odd blanks: what is left equals a loop over all places of each value."""
    rng = random.Random(3)
    values = ["10.20.30.40", "+1 415 555 2671", "4111 1111 1111 1111", "a.b@ex.com", "10000000146", "192.168.1.7:8080", "078-05-1120"]
    rows, want = [], {}
    for i in range(120):
        picked = [rng.choice(values) for _ in range(rng.randint(0, 4))]
        text = "".join(rng.choice([" see ", " and ", "; ", "  to "]) + v for v in picked) + " end"
        rows.append((i, 0, text))
        want[i] = slow_cover(text, picked)
    docs = spark.createDataFrame(rows, "doc_id int, line_index int, text string")
    keys = ["doc_id", "line_index"]
    found = review.automatic(review.add_review(detectors.detect(docs, keys)))
    masked = masking.mask(docs, found, keys)
    assert {r.doc_id: r.masked for r in masked.collect()} == want
    assert masking.leaks(masked, found, keys, ["doc_id"]).count() == 0
    half = masked.withColumn("masked", F.concat(F.substring("masked", 1, 8), F.expr("substring(text, 9)")))
    assert masking.leaks(half, found, keys).count() > 0


def test_values_are_covered_elsewhere_on_the_page(spark):
    docs = spark.createDataFrame([(1, 0, "email a.b@ex.com PASSWORD=hunter22x"), (1, 1, "so hunter22x again"), (2, 0, "hunter22x")], "doc_id int, line_index int, text string")
    keys = ["doc_id", "line_index"]
    found = detectors.detect(docs, keys)
    assert masking.leaks(masking.mask(docs, found, keys), found, keys, ["doc_id"]).count() == 1
    covered = masking.cover_pages(docs, found, keys, ["doc_id"])
    assert [r.masked for r in covered.orderBy(*keys).collect()] == ["email █████████ PASSWORD=█████████".replace("█████████", "█" * 10, 1), "so █████████ again", "hunter22x"]
    assert masking.leaks(covered, found, keys, ["doc_id"]).count() == 0


def test_every_word_of_a_detection_is_covered(spark):
    page = lines(spark, "card 4111 1111 1111 1111 here", "IBAN GB82 WEST 1234 5698 7654 32")
    found = detectors.detect(page, [*K, "line_index"], only=["credit_card", "custom_rule"])
    boxed = pages.place(found, pages.words_of(page, K), K).orderBy("line_index").collect()
    assert [(r.x0, r.x1) for r in boxed] == [(10.0 + 5 * 12, 10.0 + 24 * 12), (10.0 + 5 * 12, 10.0 + 32 * 12)]


def detection(i, kind, box, text="v", rule=None):
    return (1, i, i, kind, text, rule, kind, *map(float, box))


BOXED = "page int, id int, ordinal int, type string, text string, rule_id string, label string, x0 double, y0 double, x1 double, y1 double"


def test_suppression(spark):
    rows = [
        detection(1, "custom_rule", (0, 0, 100, 10), "GB82 WEST 1234 5698 7654 32", "iban"), detection(2, "phone", (10, 0, 60, 10)), detection(3, "email", (10, 0, 60, 10)),
        detection(4, "phone", (200, 0, 300, 10)), detection(5, "person_name", (200, 0, 300, 10)), detection(6, "location", (400, 0, 500, 10)), detection(7, "ipv4", (460, 0, 560, 10)),
        detection(8, "custom_rule", (0, 50, 100, 60), "XX00", "iban"), detection(9, "location", (0, 50, 100, 60)),
    ]
    df = spark.createDataFrame(rows, BOXED)
    assert sorted(r.id for r in spatial.suppress(df, ["page"]).collect()) == [1, 3, 4, 6, 7, 8]
    assert sorted(r.id for r in spatial.suppress(df.orderBy(F.desc("id")).repartition(5), ["page"]).collect()) == [1, 3, 4, 6, 7, 8]


def slow_dedup(rows):
    def box(r):
        return r[7:11]

    def area(b):
        return max(b[2] - b[0], 0) * max(b[3] - b[1], 0)

    def same(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = area(a) + area(b) - w * h
        iou = w * h / union if union > 0 else 0
        dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
        if abs(dy) > 10 and min(a[3], b[3]) - max(a[1], b[1]) < max(1, min(a[3] - a[1], b[3] - b[1])) * 0.5:
            return False
        return iou > 0.5 or (dx * dx + dy * dy) ** 0.5 < 20

    kept = []
    for r in sorted(rows, key=lambda r: (-len(r[4].replace(" ", "")), -area(box(r)), r[2])):
        if not any(k[3] == r[3] and same(box(k), box(r)) for k in kept):
            kept.append(r)
    return sorted(r[1] for r in kept)


def test_greedy_removal_matches_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        x, y = rng.randrange(300), rng.randrange(60)
        rows.append(detection(i, rng.choice(["phone", "email"]), (x, y, x + rng.randrange(5, 80), y + 12), "v" * rng.randrange(1, 4)))
    assert sorted(r.id for r in spatial.deduplicate(spark.createDataFrame(rows, BOXED), ["page"]).collect()) == slow_dedup(rows)


def test_rectangles_stay_on_the_page(spark):
    df = spark.createDataFrame([detection(1, "phone", (-5, 0, 20, 10)), detection(2, "phone", (90, 0, 120, 10)), detection(3, "phone", (110, 0, 120, 10))], BOXED).withColumns({"width": F.lit(100.0), "height": F.lit(50.0)})
    got = spatial.hardened(spatial.redactions(df, "pixelate")).orderBy("id").collect()
    assert [(r.id, r.x, r.w, r.style, r.color) for r in got] == [(1, 0.0, 20.0, "blackout", "#000000"), (2, 90.0, 10.0, "blackout", "#000000")]
    with pytest.raises(ValueError):
        spatial.redactions(df, "glitter")


def test_masking_leaves_nothing_to_find(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    keys, rows = ["doc_id", "line_index"], document_lines(docs)
    kinds = ["email", "credit_card", "ipv4", "phone", "env_secret"]
    found = detectors.detect(rows, keys, only=kinds)
    covered = masking.mask(rows, found, keys)
    assert covered.where(F.length("masked") != F.length("text")).count() == 0
    assert found.count() > 0 and masking.leaks(covered, found, keys).count() == 0
    assert detectors.detect(covered.select(*keys, F.col("masked").alias("text")), keys, only=kinds).where("type <> 'env_secret'").count() == 0
    assert masking.leaks(rows.withColumn("masked", F.col("text")), found, keys).count() > 0


def test_overlapping_spans_are_masked_once(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, None)], "id int, text string")
    spans = spark.createDataFrame([(1, 1, "bcd"), (1, 2, "cdef"), (1, 1, "bcd"), (1, 9, "j"), (1, None, "zz")], "id int, start int, span string")
    assert {r.id: r.masked for r in masking.mask(docs, spans, ["id"]).collect()} == {1: "a█████ghi█", 2: None}


def test_names_and_tools(spark):
    names = spark.createDataFrame([(1, 1, "a/x.png"), (1, 2, "b\\x.png"), (1, 3, "x"), (1, 4, "x")], "b int, o int, name string")
    assert [r.zip_name for r in masking.unique_names(names, ["b"], "o").orderBy("o").collect()] == ["x.png", "x-2.png", "x", "x-2"]
    found = spark.createDataFrame([(1, "email", None), (2, "tckn", "tckn"), (3, "custom_rule", "iban"), (4, "phone", None)], "id int, type string, rule_id string")
    assert sorted(r.id for r in review.for_tool(found, ["email"]).collect()) == [1, 2, 3]
    assert review.for_tool(found, []).count() == 4 and review.in_profile(found).count() == 4
    views = review.for_tools(found, review.tools_table(spark)).where("slug = 'blur-email'")
    assert sorted(r.id for r in views.collect()) == [1, 2, 3]


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.bin").write_bytes(b"\x89PNG\r\n\x1a\n")
    assert {(r.name, r.kind, r.size) for r in files(spark, str(tmp_path)).collect()} == {("a.PDF", "pdf", 1), ("b.bin", "png", 8)}


def test_lists_are_complete():
    assert len(fixed.IBAN_LENGTHS) == 82 and len(fixed.PROVINCES) == 81 and len(fixed.GIVEN_NAMES) == 124 and len(fixed.SURNAMES) == 64
