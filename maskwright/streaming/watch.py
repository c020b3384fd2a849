"""Streams of documents: the batch detectors in every micro-batch, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.functions import detectors
from maskwright.operators.review import add_review
from maskwright.sources.tables import document_lines


def detections(docs: DataFrame) -> DataFrame:
    return add_review(detectors.detect(document_lines(docs), ["doc_id", "line_index"]))


def watch(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Documents that arrive as Parquet under ``path``; their detections are appended under ``out``, a folder for each micro-batch.

    A batch that is run again overwrites its own folder, so restarts leave each detection once.
    """

    def write(batch: DataFrame, number: int) -> None:
        detections(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).parquet(path)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def email_counts(events: DataFrame, ts_col: str = "ts", text_col: str = "props", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows with an address for each window of event time; works on streams and tables alike."""
    from maskwright.functions import fixed

    return events.withWatermark(ts_col, late).groupBy(F.window(ts_col, width).alias("w")).agg(F.count("*").alias("n_rows"), F.sum(F.col(text_col).rlike(fixed.EMAIL).cast("long")).alias("n_with_email")).select(F.col("w.start").alias("window_start"), "n_rows", "n_with_email")
