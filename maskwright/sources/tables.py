"""Readers: tables as rows of text under a common key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_index, text: one row for each line with a character that isn't white space."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line_index", "text"))
    return parts.where(F.trim("text") != "")


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text: visible text of HTML pages."""
    return pages.select("page_id", "url", T.strip_html(F.coalesce("html", F.lit(""))).alias("text"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, kind and content of image and PDF files; the kind is judged by name and by leading bytes."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    magic = F.hex(F.substring("content", 1, 8))
    kind = F.when(F.lower(name).endswith(".pdf") | F.startswith(magic, F.lit("25504446")), "pdf").when(F.startswith(magic, F.lit("89504E47")), "png").when(F.startswith(magic, F.lit("FFD8FF")), "jpeg").when(magic.rlike("^52494646"), "webp").otherwise("other")
    return raw.select("path", name.alias("name"), F.col("length").alias("size"), kind.alias("kind"), "content")


def rules(spark: SparkSession, path: str, most: int = 1000) -> list:
    """Rules of a JSON settings file; rows that make no usable rule are left out. Over ``most`` rows are an error."""
    from maskwright.functions.detectors import Rule

    rows = spark.read.json(path).limit(most + 1).collect()  # a settings file, not data
    if len(rows) > most:
        raise ValueError(f"over {most} rules in {path}: each is a pattern over every row")
    return [r for r in (Rule.of(row.asDict()) for row in rows) if r]


SPREAD_BYTES = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores where they are few bytes: a small file is one partition, and a search costs far more than its shuffle.

    Larger inputs have partitions enough and stay as they are. The size is the planner's estimate, so nothing is run for it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPREAD_BYTES else rows


PART_BYTES = 1 << 20


def dealt(rows: DataFrame, *keys: str, grows: int = 1) -> DataFrame:
    """``rows`` shuffled by ``keys`` into as many parts as the planner's estimate of their bytes asks for, and no fewer than there are cores.

    ``grows``: how many times wider than usual the rows become that are made of each.

    For windows and lists over narrow rows, which hold many times in a task what was moved to it: parts that are joined by moved bytes alone grow too large.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, min(size * grows // PART_BYTES + 1, 20_000)), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table of a query's own: in the cluster's shared folder, or on this machine where the master is local."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/maskwright-tables"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table of their own, for what is read more than once and costs far more to find than to keep."""
    at = scratch(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
