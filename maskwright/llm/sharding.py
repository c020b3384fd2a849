"""Sharding by a Feistel permutation: a reproducible shuffle whose shard and slot can be computed for any row.

Rows are numbered 0..N-1 in ascending order of id (ties by a column that the caller names, such as a hash of the text). A balanced Feistel network over the next even
power of two permutes the numbers; values outside 0..N-1 are walked along their cycle until they fall inside, so the
whole is a bijection. Shard = permuted number mod shards and slot = the quotient: shard sizes differ by one at most, and
``row_of`` inverts both without the data.

Numbering is one range partitioning: each part stores positions within itself, and parts' counts (one row a part)
give their offsets. Defined results: null ids come first; repeated rows get numbers of their own; null texts have
size 1; an empty table gives an empty result; extra columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.runtime import Stages, bounded_broadcast, without

ROUNDS = 6


def _mix(half: np.ndarray, key: int) -> np.ndarray:
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64) >> np.uint64(1)]


def _half_bits(n: int) -> np.uint64:
    return np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Where each row number in 0..n-1 goes; with ``inverse``, where it came from."""
    bits = _half_bits(n)
    mask, out = (np.uint64(1) << bits) - np.uint64(1), rows.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        if inverse:
            for key in reversed(_keys(seed)):
                left, right = right ^ (_mix(left, key) & mask), left
        else:
            for key in _keys(seed):
                left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def row_of(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def number_rows(docs: DataFrame, id_col: str = "doc_id", tie: Column | None = None) -> tuple[DataFrame, int]:
    """``docs`` with ``row_number`` 0..N-1 in id order, rows of one id in the order of ``tie``, and N. The numbered rows are a written table.

    All columns of ``docs`` go through the range partitioning: callers select what they need first.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    order = [F.col(id_col), *([] if tie is None else [tie])]
    dealt = without(docs, "row_number", "_part", "_place").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = Stages(spark, "sharding").write(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "rows")
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_first"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("parts")).first()
    joined = placed.join(bounded_broadcast(offsets, total.parts), "_part")
    return joined.withColumn("row_number", F.col("_first") + F.col("_place")).drop("_part", "_place", "_first"), total.n


def assign(docs: DataFrame, shards: int = 8, seed: int = 9, id_col: str = "doc_id", tie: Column | None = None) -> DataFrame:
    """``docs`` with shard, slot (gapless from 0 in each shard) and law ("rows": counts are one apart at most)."""
    rows, n = number_rows(without(docs, "shard", "slot", "law"), id_col, tie)

    @F.pandas_udf("long")
    def placed(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    at = rows.withColumn("_at", placed("row_number")).drop("row_number")
    return at.select(*[c for c in at.columns if c != "_at"], (F.col("_at") % shards).cast("int").alias("shard"), F.floor(F.col("_at") / shards).cast("long").alias("slot"), F.lit("rows").alias("law"))


def write_shards(assigned: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """One folder a shard, files in slot order."""
    block = F.floor(F.col("slot") / rows_per_file)
    assigned.repartition(F.col("shard"), block).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
