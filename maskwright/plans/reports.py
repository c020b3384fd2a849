"""Counts of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(found: DataFrame, docs: DataFrame, by: list[str], id_col: str = "doc_id") -> DataFrame:
    """Counts by each prefix of ``by``, totals included."""
    return found.join(docs.select(id_col, *by), id_col).rollup(*by).agg(F.count("*").alias("n"))


def summary(found: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """lang, type, n, n_docs and n_review."""
    return found.join(docs.select(id_col, "lang"), id_col).groupBy("lang", "type").agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("n_docs"), F.sum(F.col("needs_review").cast("long")).alias("n_review"))
