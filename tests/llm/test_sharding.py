import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    rows = np.arange(n)
    to = sharding.permute(rows, n, 9)
    assert sorted(to) == rows.tolist()
    assert (sharding.permute(to, n, 9, inverse=True) == rows).all()
    if n > 100:
        assert abs(np.corrcoef(rows, to)[0, 1]) < 0.2 and (sharding.permute(rows, n, 10) != to).any()


def placed(rows):
    return sorted((r.shard, r.slot, r.doc_id) for r in rows)


def test_query_law_and_reproducibility(spark):
    at = "/root/testdata/sf0.001"
    rows = queries.op9_sharding(spark, at).collect()
    counts = {}
    for r in rows:
        counts.setdefault(r.shard, []).append(r.slot)
    assert set(counts) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    docs = spark.read.parquet(f"{at}/documents.parquet")
    again = sharding.assign(docs.repartition(7), shards=8).collect()
    assert placed(again) == placed(rows)
    ids = sorted(r.doc_id for r in rows)
    assert all(ids[sharding.row_of(r.shard, r.slot, len(ids), 8, 9)] == r.doc_id for r in rows)


def test_odd_rows_and_files(spark, odd_docs, no_docs, tmp_path):
    rows = sharding.assign(odd_docs.withColumns({"Shard": F.lit("x"), "slot": F.lit("y"), "law": F.lit(1), "row_number": F.lit(0)}), shards=3, tie=F.xxhash64("text"))
    assert rows.count() == odd_docs.count() and sharding.assign(no_docs).count() == 0 and sum(c.lower() == "shard" for c in rows.columns) == 1
    assert len({(r.shard, r.slot) for r in rows.collect()}) == odd_docs.count()
    sharding.write_shards(rows, f"file://{tmp_path}/out", rows_per_file=2)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.shard, r.slot, r.text or "") for r in back.collect()) == sorted((r.shard, r.slot, r.text or "") for r in rows.collect())


def test_query_columns_equal_the_texts(spark, tmp_path, odd_docs):
    """size, text_crc32, law and grown_shard, over a table with null, empty and repeated rows; shards take turns, slots have no gap."""
    import zlib

    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/in/documents.parquet")
    for at in (f"{tmp_path}/in", "/root/testdata/sf0.001"):
        docs = spark.read.parquet(f"{at}/documents.parquet").collect()
        rows = queries.op9_sharding(spark, at).collect()
        raw = [(d.doc_id, (d.text or "").encode()) for d in docs]
        assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i or 0, len(t) + 1, zlib.crc32(t)) for i, t in raw)
        assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
        for shard in range(8):
            slots = sorted(r.slot for r in rows if r.shard == shard)
            assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 8, -(-len(rows) // 8))
