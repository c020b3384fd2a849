"""Masking of text and the checks after it.

Keys may be null and need not be unique: rows with equal keys, null ones among them, are one row's copies, and what is found in any of them
is covered in all. So nothing stays readable for want of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.patterns import occurrences
from maskwright.operators.joins import meet


PLACES = "array<struct<a:int,b:int>>"


def spans_of(detections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, spans (array of half-open places, sorted) and terms (distinct span texts) of each row with detections."""
    at = F.struct(F.col("start").cast("int").alias("a"), (F.col("start") + F.length("span")).cast("int").alias("b"))
    placed = F.filter(F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), at))), lambda x: x["b"] > x["a"])
    return detections.groupBy(*keys).agg(placed.alias("spans"), F.collect_set("span").alias("terms"))


def covered(text: Column, spans: Column, char: str = "█") -> Column:
    """``text`` with every character of the sorted places replaced; overlaps and repeats are harmless."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        first, last = F.greatest(x["a"], s["at"]), F.least(x["b"], F.length(text))
        return F.when(last <= first, s).otherwise(F.struct(last.alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, first - s["at"]), F.repeat(F.lit(char), last - first)).alias("out")))

    masked = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(spans.isNull(), text).otherwise(masked)


def mask(docs: DataFrame, spans: DataFrame, keys: list[str], text_col: str = "text", char: str = "█") -> DataFrame:
    """``docs`` with ``masked``: every character of a span (keys, start, span) replaced; a row without spans keeps its text."""
    parts = spans_of(spans, keys).select(*keys, F.col("spans").alias("_spans"))
    joined = meet(docs, parts, keys, "left")
    return joined.withColumn("masked", covered(F.col(text_col), F.col("_spans").cast(PLACES), char)).drop("_spans")


def uncovered(text: Column, masked: Column, term: Column, char: str = "█") -> Column:
    """Whether a character of any occurrence of ``term`` in ``text`` is still to be read in ``masked``, which is as long."""
    open_ = lambda x: F.replace(F.substring(masked, x["start"] + 1, x["size"]), F.lit(char), F.lit("")) != ""
    return F.exists(occurrences(text, term), open_)


def leaks(masked: DataFrame, detections: DataFrame, keys: list[str], page_keys: list[str] | None = None, text_col: str = "masked", source_col: str = "text") -> DataFrame:
    """keys (of the rows that leak) and span of every value longer than two characters that can be read, whole or in part.

    Values are looked for wherever they stand in the original text of the same ``page_keys`` (by default the value's own row), as whole words.
    """
    page_keys = page_keys or keys
    terms = detections.select(*page_keys, F.trim("span").alias("span")).where(F.length("span") > 2).distinct()
    rows = masked.select(*keys, F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    met = meet(rows, terms, page_keys).where(F.contains("_source", F.col("span")))
    return met.where(uncovered(F.col("_source"), F.col("_text"), F.col("span"))).select(*keys, "span")


def cover_pages(lines: DataFrame, detections: DataFrame, keys: list[str], page_keys: list[str], char: str = "█", keep_terms: bool = False) -> DataFrame:
    """``lines`` with ``masked``: every span at its place, and the same values wherever else they stand on the page.

    One pass: a row meets its own places and the page's terms, both arrays. Terms of three characters and more spread over the page;
    ``keep_terms`` leaves those that the row holds in ``terms``, for a check.
    """
    spans = spans_of(detections, keys)
    terms = spans.select(*page_keys, F.explode("terms").alias("_t")).where(F.length("_t") > 2).groupBy(*page_keys).agg(F.sort_array(F.collect_set("_t")).alias("_terms"))
    joined = meet(meet(lines, spans.select(*keys, "spans"), keys, "left"), terms, page_keys, "left")
    text = F.col("text")
    near = F.filter(F.coalesce("_terms", F.array().cast("array<string>")), lambda t: F.contains(text, t))
    elsewhere = F.flatten(F.transform(near, lambda t: F.transform(occurrences(text, t), lambda x: F.struct(x["start"].alias("a"), (x["start"] + x["size"]).alias("b")))))
    every = F.sort_array(F.concat(F.coalesce("spans", F.array().cast(PLACES)), F.coalesce(elsewhere.cast(PLACES), F.array().cast(PLACES))))
    with_all = joined.withColumn("_all", every)
    return with_all.withColumn("masked", F.when(F.size("_all") > 0, covered(text, F.col("_all"), char)).otherwise(text)).withColumn("terms", near if keep_terms else F.lit(None)).drop("spans", "_terms", "_all", *([] if keep_terms else ["terms"]))


def unique_names(files: DataFrame, batch_keys: list[str], order_col: str, name_col: str = "name") -> DataFrame:
    """``files`` with ``zip_name``: a repeated base name gets its number in the batch before the extension."""
    base = F.regexp_extract(F.col(name_col), r"([^/\\]*)$", 1)
    rows = files.withColumn("_base", base)
    number = F.row_number().over(Window.partitionBy(*batch_keys, "_base").orderBy(order_col))
    stem, ext = F.regexp_extract("_base", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_base", r"^(.*?)(\.[^.]*)?$", 2)
    return rows.withColumn("_n", number).withColumn("zip_name", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ext))).drop("_base", "_n")


def select_batch(files: DataFrame, batch_keys: list[str], order_col: str, most: int = 20, largest: int = 25 * 1024 * 1024) -> DataFrame:
    """``files`` (name, size) with ``status``: queued up to the batch's limit, else the reason they are skipped."""
    fine = F.lower("name").rlike(r"\.(?:png|jpe?g|webp|pdf)$") & (F.col("size") <= largest)
    rows = files.withColumn("_ok", F.coalesce(fine, F.lit(False)))
    place = F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(*batch_keys).orderBy(order_col))
    return rows.withColumn("status", F.when(~F.col("_ok"), "skipped").when(place <= most, "queued").otherwise("over_limit")).drop("_ok")
