import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maskwright.llm import queries, simhash
from maskwright.llm.graph import connected_components
from maskwright.llm.runtime import Stages


def slow_fingerprint(text):
    words = (text or "").translate({c: chr(c + 32) for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, tau=2):
    fps = np.array(fps, np.uint64)
    least = np.array(ids, np.int64)
    links = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= tau
    while True:
        new = np.where(links, least[None, :], least.max() + 1).min(1)
        if (new == least).all():
            return least.tolist()
        least = new


def test_fingerprint_matches_definition():
    for text in ["", "one", "One two", "a b c d e f g", "x\x0by z " * 50, "été ÉTÉ été   b"]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_query_matches_brute_force(spark):
    at = "/root/testdata/sf0.001"
    rows = queries.op2_simhash_near_dedup(spark, at).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{at}/documents.parquet").orderBy("doc_id").collect()
    fps = [slow_fingerprint(d.text) for d in docs]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in rows] == slow_components([d.doc_id for d in docs], fps)


@pytest.mark.parametrize("hot, tau", [(1, 2), (4, 2), (1000, 2), (2, 5), (1000, 5), (3, 0), (2, 8)])
def test_links_are_exact_even_in_hot_buckets(spark, hot, tau):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, tau + 2))) for b in base for _ in range(12)]
    fps = sorted({int(x) for x in base} | set(near))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {tuple(sorted((r.src % (1 << 64), r.dst % (1 << 64)))) for r in simhash.linked_pairs(df, Stages(spark, "t"), tau, hot).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= tau}
    assert got == want and (len(want) > 100 or tau == 0)


def test_thresholds_sum_to_the_budget():
    cost, chosen = simhash.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 3}, {-1: 0, 0: 9}], 0)
    assert sum(chosen) == 0 and cost == 8 and chosen == [0, 1, -1]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 3), (5, 6), (6, 5), (7, 7)], "src long, dst long")
    assert dict(connected_components(edges, Stages(spark, "t")).collect()) == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}
    assert connected_components(edges.limit(0), Stages(spark, "t")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8, 9]
    assert simhash.keep_first(no_docs).count() == 0
    rows = simhash.near_duplicates(simhash.add_fingerprints(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert {r.component_id for r in rows if r.text == "one two"} == {7}
