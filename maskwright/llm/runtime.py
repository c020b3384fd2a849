"""Shared plumbing: stage tables in the cluster's checkpoint folder, and pass-through Arrow maps."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what ``SparkContext.setCheckpointDir`` was given.

    Only on a local master (tests on one machine) may it be unset: then a temporary folder serves. Elsewhere that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/maskwright-stages"
    return found.rstrip("/")


_folders: list[str] = []


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_stages(spark: SparkSession) -> None:
    """Deletes every stage table that this driver has written; results that still read them must have been saved."""
    while _folders:
        _delete(spark, _folders.pop())


class Stages:
    """Written tables that cut lineage: each survives the loss of any executor.

    Names are unique to one operator call. ``drop`` removes a table that later steps no longer read;
    tables that the returned DataFrame reads stay until ``clear_stages`` is called or the folder's owner cleans it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.step = 0
        _folders.append(self.root)

    def path(self, name: str) -> str:
        self.step += 1
        return f"{self.root}/{self.step:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.parquet(at)
        back = self.spark.read.schema(df.schema).parquet(at)
        back.stage_path = at
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self.spark, table.stage_path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add; names compare as Spark's do, without case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken])


_trimmed = [0.0]


def trim(every: float = 1.5) -> None:
    """Gives memory that a Python worker has freed back to its machine, at most once in ``every`` seconds: workers live on and serve the stages to come."""
    if time.monotonic() - _trimmed[0] < every:
        return
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other libraries manage without
    if give_back is not None:
        give_back(0)
    _trimmed[0] = time.monotonic()


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_batch_rows: set[str] = set()  # what ``small_batches`` has set


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of ``rows`` rows, for entry points: ten thousand whole texts at once fill a worker.

    A value that the session's owner set stays, whatever it is. Operators never change the session; they cut batches further.
    """
    held = spark.conf.getAll.get(BATCH_KEY)
    if held is None or held in _batch_rows:
        _batch_rows.add(str(rows))
        spark.conf.set(BATCH_KEY, str(rows))


def add_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    compute: Callable[[pa.Array], list],
    max_rows: int = 2048,
) -> DataFrame:
    """``df`` with ``fields`` appended, computed batch by batch from the text column.

    Other columns pass through unread; those whose names clash with the new ones are replaced.
    """
    rest = without(df, *[f.name for f in fields])
    at = [c.lower() for c in rest.columns].index(text_col.lower())
    types = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in fields])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, max_rows):
                trim()
                batch = whole.slice(start, max_rows)
                new = [pa.array(v, type=t.type) if not isinstance(v, pa.Array) else v.cast(t.type) for v, t in zip(compute(batch.column(at)), types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *types.names])

    return rest.mapInArrow(over, T.StructType([*rest.schema.fields, *fields]))


def keep_rows(df: DataFrame, text_col: str, decide: Callable[[pa.Array], np.ndarray], max_rows: int = 128) -> DataFrame:
    """The rows of ``df`` for whose texts ``decide`` is true; no column is added, renamed or dropped."""
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, max_rows):
                trim()
                batch = whole.slice(start, max_rows)
                yield batch.filter(pa.array(decide(batch.column(at)), pa.bool_()))

    return df.mapInArrow(over, df.schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def bounded_broadcast(small: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """``small`` marked for broadcast only where its counted rows stay under the bound; else joined by shuffle."""
    return F.broadcast(small) if rows <= most else small


def hash_sample(df: DataFrame, rows: int, wanted: int, seed: int, *columns: str) -> DataFrame:
    """About twice ``wanted`` of the ``rows`` rows of ``df``, or all of a small table, drawn by a hash of ``columns``.

    Callers cut the rest with a limit: what a task sends on is a share of its rows, and never ``wanted`` from each.
    """
    share = min(1.0, (2 * wanted + 64) / max(rows, 1))
    return df.where(F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def draw(rows: DataFrame, order: list[Column], most: int, most_bytes: int, text_col: str = "text") -> list:
    """The first rows by ``order``, ``most`` of them and ``most_bytes`` of text at most, gathered: for fits on the driver.

    ``rows`` should be a sample of about that size already. The bounds cut in a defined order, so a run can be repeated.
    """
    bounded = rows.withColumn("_size", F.octet_length(text_col)).where(F.col("_size") <= most_bytes).orderBy(*order).limit(most)
    # One window over at most ``most`` rows.
    upto = bounded.withColumn("_sum", F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return upto.where(F.col("_sum") <= most_bytes).drop("_size", "_sum").collect()


def heavy_keys(counts: DataFrame, key: str, n: str, share: int = 1000, least: int = 10_000) -> list[int]:
    """Keys that hold over a ``share``-th of all rows of ``counts`` (key, n): fewer than ``share`` of them, so they may be gathered."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > max(total // share, least)).select(key).collect()]


def join_spread(rows: DataFrame, named: DataFrame, key: str, heavy: list[int]) -> DataFrame:
    """``rows`` joined to ``named`` (one row a key): rows of heavy keys stay where they are and meet a broadcast of those few keys."""
    if not heavy:
        return rows.join(named, key)
    hot = F.col(key).isin(heavy)
    return rows.where(hot).join(F.broadcast(named.where(hot)), key).unionByName(rows.where(~hot).join(named.where(~hot), key))
