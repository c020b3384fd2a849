"""What the findings of the third round say of larger tables: each test failed before its change."""

import random
import re

from maskwright.functions import patterns
from maskwright.operators import pages, regions
from maskwright.plans import joined, pictures, planted
from maskwright.sources import tables

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_shuffles_words_by_page_alone(spark):
    for name in ("merged_readings", "spatial_candidates"):
        moved = [line for line in plan_of(pictures.QUERIES[name](spark, SF)).splitlines() if "Exchange hashpartitioning" in line]
        assert moved and all("hashpartitioning(l_orderkey#" in line for line in moved), name


def test_merging_is_the_same_on_few_words_and_over_cells(spark, monkeypatch):
    draw = random.Random(3)
    side = lambda most: float(draw.randrange(most))
    rows = []
    for n in range(240):
        x, y, text = side(400), side(200), draw.choice(["10000000146", "a", "b"])
        rows.append((None if n % 3 else 7, n, text, x, y, x + 20 + side(60), y + 12))
    words = spark.createDataFrame(rows, "page long, ordinal int, text string, x0 double, y0 double, x1 double, y1 double")
    first, second = words.where("ordinal % 4 = 0"), words.where("ordinal % 4 > 0")
    shown = lambda: sorted((r.page or 0, r.ordinal) for r in regions.merged_words(first, second.union(second), ["page"]).collect())
    over_cells = shown()
    monkeypatch.setattr(regions, "FEW", 1000)
    assert shown() == over_cells and 60 < len(over_cells) < 240


def test_items_are_dealt_by_page_into_parts_that_grow_with_them(spark, monkeypatch):
    assert "REPARTITION_BY_NUM" in plan_of(joined.QUERIES["lines_from_items"](spark, SF))
    parts = lambda: tables.dealt(tables.table(spark, SF, "lineitem"), "l_orderkey").rdd.getNumPartitions()
    assert parts() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "PART_BYTES", 1 << 12)
    assert parts() > 20


def test_words_are_cut_without_a_shuffle(spark):
    long = " ".join(f"w{n}{' ' * (n % 4)}" for n in range(700))
    texts = ["", "a", "  b  c ", "x\ty  z", "ends ", long, "\t" + long + "\t"]
    lines = spark.createDataFrame([(n if n else None, 0, t, 10.0, 20.0, 10.0 + 12 * len(t), 36.0, 92.0) for n, t in enumerate(texts)], "doc_id long, line_index int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    cut = pages.words_of(lines, ["doc_id"])
    assert "Exchange" not in plan_of(cut)
    got = [(r.doc_id, r.word_index, r.text, r.start, r.x0, r.x1) for r in cut.orderBy("doc_id", "start").collect()]
    blank = patterns.SPACE[1:-1]
    want = [(n or None, k, m.group(), m.start(), 10.0 + 12 * m.start(), 10.0 + 12 * m.end()) for n, t in enumerate(texts) for k, m in enumerate(re.finditer(f"[^{blank}]+", t))]
    assert [g[:4] for g in got] == [w[:4] for w in want] and all(abs(a - b) < 1e-6 for g, w in zip(got, want) for a, b in zip(g[4:], w[4:]))


def test_pieces_of_addresses_are_dealt_before_they_are_made(spark):
    moved = [line for line in plan_of(planted.QUERIES["address_pieces"](spark, SF)).splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "hashpartitioning(o_orderkey#" in moved[0]


def test_texts_of_seed_phrases_are_dealt_before_they_are_made(spark):
    plan = plan_of(planted.QUERIES["planted_seed_phrases"](spark, SF))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("hashpartitioning(c_custkey#" in line and "REPARTITION_BY_NUM" in line for line in moved if "_n#" not in line and "word#" not in line)


def test_columns_are_carried_through_private_keys_without_a_join_of_all_lines(spark):
    text = "see -----BEGIN RSA PRIVATE KEY-----\nMII" + "ab" * 20 + "\n-----END RSA PRIVATE KEY----- end"
    lines = pages.lay_out(spark.createDataFrame([(1, text), (None, text), (2, "prose")], "doc_id long, text string"))
    found = pages.private_key_detections(lines, ["doc_id"], ("page", "y0"))
    joins = lambda df: plan_of(df).count("Join")
    assert joins(found) == joins(pages.private_key_detections(lines, ["doc_id"]))
    assert sorted((r.doc_id or 0, r.line_index, r.page, r.y0) for r in found.collect()) == [(d, i, 1, 20.0 + 24 * i) for d in (0, 1) for i in range(3)]
