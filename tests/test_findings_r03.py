"""One test for each finding of the third round that was right: each failed before its change."""

from pyspark.sql import functions as F

from maskwright.functions import detectors, patterns
from maskwright.operators import image, regions, textmap
from maskwright.plans import catalog, planted
from maskwright.plans import pictures as P

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pictures_are_never_broadcast(spark):
    made = P.pictures(spark, SF)
    assert "BuildLeft" not in plan_of(regions.crops(made, regions.text_bands(made)))


def test_pixels_meet_no_join_in_the_queries(spark):
    for name in ("cut_and_mapped_back", "picture_bands", "picture_regions", "burnt_pictures"):
        plan = plan_of(P.QUERIES[name](spark, SF))
        lines = [line for line in plan.splitlines() if "MapInArrow" in line or "Join" in line]
        first_join = next((i for i, line in enumerate(lines) if "Join" in line), len(lines))
        assert not any("MapInArrow" in line for line in lines[first_join:]), name


def test_carried_lists_and_joined_ones_agree(spark):
    made = P.pictures(spark, SF).where("id < 40")
    cut = spark.range(0, 40, 3).select("id", F.lit(0).alias("region"), (F.col("id") * 5).alias("x"), F.col("id").alias("y"), F.lit(20).alias("width"), F.lit(9).alias("height"))
    shown = lambda df: sorted(map(tuple, df.withColumn("pixels", F.md5("pixels")).collect()), key=str)
    joined = shown(regions.crops(made, cut, scale=2))
    assert joined == shown(regions.crops(P.pictures(spark, SF, regions.region_lists(cut)).where("id < 40"), scale=2)) and len(joined) == 14
    bands = shown(regions.band_crops(made))
    assert bands == shown(regions.crops(made, regions.text_bands(made))) and len(bands) == 40
    boxes = cut.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(9.0).alias("w"), F.lit(9.0).alias("h"))
    assert shown(image.burn(made, boxes)) == shown(image.burn(P.pictures(spark, SF, image.rectangle_lists(boxes)).where("id < 40")))
    read = cut.where("id % 2 = 0").select("id", *[F.lit(float(v)).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 150, 64))])
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert plain(regions.find_regions(made, read)) == plain(regions.find_regions(P.pictures(spark, SF, regions.covered_lists(read)).where("id < 40")))


def test_pictures_that_do_not_fit_their_size_have_no_band_cut(spark):
    rows = [(1, 12, 10, bytearray(120)), (2, 12, 10, bytearray(7)), (3, 12, 10, None)]
    made = spark.createDataFrame(rows, "id long, width int, height int, pixels binary")
    got = [(r.id, r.width, r.height, r.error) for r in regions.band_crops(made).collect()]
    assert got == [(r.id, r.width, r.height, r.error) for r in regions.crops(made, regions.text_bands(made)).collect()] == [(1, 12, 10, None)]


def test_planted_checks_hold_for_keys_whose_digests_begin_like_tokens(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (35483, 112817, 145994, 40778)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.k: r.token for r in planted.QUERIES["planted_checks"](spark, str(tmp_path)).collect()}
    assert got == {k: k % 3 == 0 for k in (35483, 112817, 145994, 40778)}


def test_seed_windows_are_the_planted_ones_alone(spark, tmp_path):
    words = [f"word{chr(97 + i)}" for i in range(26)]
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(1, 0, " ".join(words[3:17])), (2, 0, "so " + " ".join(words[3:17])), (4, 1, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.text, r.start_word) for r in catalog.QUERIES["seed_phrase_windows"](spark, str(tmp_path)).collect()}
    run = lambda at: " ".join(words[(at + i) % 26] for i in range(12))
    assert got == {(2, 0): (run(14), 16), (4, 1): (run(29), 1)}


def test_a_range_is_worked_out_from_texts_folded_once(spark):
    # Each name in a lambda's body is worked out anew for each character or step.
    assert str(textmap.match_range(F.col("a"), F.col("b"), F.lit(0))._jc).count("translate(") <= 4


def test_ranges_without_blanks_and_dashes(spark):
    rows = [("Say DE 12-34 ab", "de1234", 0, (4, 8)), ("Say DE 12-34 ab", "12-34AB", 0, (7, 8)), ("a b a b", "AB", 1, (4, 3)), ("by Maya'nın", "maya", 0, (3, 8)), ("x", "y", 0, None), ("", "y", 0, None), ("x", " ", 0, None), ("+9O 1", "9O", 0, (1, 2))]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, t string, m string, n int")
    got = [tuple(r.r) if r.r else None for r in df.select("i", textmap.match_range(F.col("t"), F.col("m"), F.col("n")).alias("r")).orderBy("i").collect()]
    assert got == [r[3] for r in rows]


def test_phones_and_tokens_are_sought_once_a_text(spark):
    # The patterns of phones stand once for each use; before, what one list of matches had been made of was named again for each match.
    shown = lambda c: len(c._jc.toString())
    assert shown(detectors.phone_hits(F.col("t"))) < 30_000
    assert str(patterns.located(F.col("t"), "x+")._jc).count("regexp_replace") == 1
    assert str(patterns.loose_occurrences(F.col("t"), F.col("v"))._jc).count("split(") == 1


def test_values_are_located_among_loose_characters(spark):
    row = spark.range(1).select(patterns.loose_occurrences(F.lit("a-b C, ab_c x"), F.lit("ab c")).alias("l"), patterns.occurrences(F.lit("ab abc ab"), F.lit("ab")).alias("w"), patterns.occurrences(F.lit("ababab"), F.lit("ab"), False).alias("a"), patterns.loose_occurrences(F.lit("xy"), F.lit("-")).alias("n")).first()
    assert [tuple(x) for x in row.l] == [(0, 5), (7, 4)] and [tuple(x) for x in row.w] == [(0, 2), (7, 2)] and [x.start for x in row.a] == [0, 2, 4] and row.n == []
