"""Box arithmetic: pixels to shares of a page and back, padding, envelopes, and boxes of positioned text items.

Boxes are columns x0, y0, x1, y1. A box that isn't finite or has no area is null in all four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators.spatial import BOX

# How far a glyph rises above its baseline, and the margin around an item, as shares of the font's height.
ASCENT, ASCENT_LEAST, ASCENT_MOST, MARGIN = 0.8, 0.55, 0.95, 0.14


def finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return out


def normalized(rows: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """``rows`` with norm_x, norm_y, norm_width, norm_height: the box in shares of the page, null where either has no area."""
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    ok = finite(*[F.col(c).cast("double") for c in BOX]) & (w > 0) & (h > 0) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    share = {"norm_x": F.col("x0") / w, "norm_y": F.col("y0") / h, "norm_width": (F.col("x1") - F.col("x0")) / w, "norm_height": (F.col("y1") - F.col("y0")) / h}
    return rows.withColumns({k: F.when(ok, v) for k, v in share.items()})


def mapped(rows: DataFrame, width: str, height: str) -> DataFrame:
    """``rows`` with x, y, w, h: normalised boxes on a canvas of another size."""
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    ok = (w > 0) & (h > 0)
    return rows.withColumns({"x": F.when(ok, F.col("norm_x") * w), "y": F.when(ok, F.col("norm_y") * h), "w": F.when(ok, F.col("norm_width") * w), "h": F.when(ok, F.col("norm_height") * h)})


def padded(rows: DataFrame, padding: float = 2.0) -> DataFrame:
    """Boxes grown on all sides; those without a finite area stay as they are."""
    grown = [F.col("x0") - padding, F.col("y0") - padding, F.col("x1") + padding, F.col("y1") + padding]
    ok = finite(*grown) & (grown[2] > grown[0]) & (grown[3] > grown[1]) & F.lit(padding > 0)
    return rows.withColumns({c: F.when(ok, g).otherwise(F.col(c)) for c, g in zip(BOX, grown)})


def touching(words: DataFrame, envelopes: DataFrame, page_keys: list[str]) -> DataFrame:
    """words x envelopes of the same page (prefix e_) whose boxes touch, edges included."""
    others = envelopes.select(*page_keys, *[F.col(c).alias(f"e_{c}") for c in envelopes.columns if c not in page_keys])
    apart = (F.col("x1") < F.col("e_x0")) | (F.col("x0") > F.col("e_x1")) | (F.col("y1") < F.col("e_y0")) | (F.col("y0") > F.col("e_y1"))
    return words.join(others, page_keys).where(~apart)


def multiplied(a: Column, b: Column) -> Column:
    """Product of two affine transforms, arrays of six."""
    at = lambda m, k: F.get(m, F.lit(k))
    return F.array(
        at(a, 0) * at(b, 0) + at(a, 2) * at(b, 1), at(a, 1) * at(b, 0) + at(a, 3) * at(b, 1),
        at(a, 0) * at(b, 2) + at(a, 2) * at(b, 3), at(a, 1) * at(b, 2) + at(a, 3) * at(b, 3),
        at(a, 0) * at(b, 4) + at(a, 2) * at(b, 5) + at(a, 4), at(a, 1) * at(b, 4) + at(a, 3) * at(b, 5) + at(a, 5),
    )


def item_boxes(items: DataFrame, viewport: list[float], ascent: float = ASCENT, margin: float = MARGIN) -> DataFrame:
    """``items`` (transform array<double>, width) with the box of their glyphs on the viewport; items without height go."""
    rise = min(ASCENT_MOST, max(ASCENT_LEAST, ascent))
    rows = items.withColumn("_t", multiplied(F.array(*map(F.lit, viewport)), F.col("transform")))
    at, own = (lambda k: F.get("_t", F.lit(k))), (lambda k: F.get("transform", F.lit(k)))
    font = F.hypot(at(2), at(3))
    size = F.coalesce(F.nullif(F.hypot(own(2), own(3)), F.lit(0.0)), F.nullif(F.hypot(own(0), own(1)), F.lit(0.0)), F.lit(1.0))
    width = F.when(F.col("width") > 0, F.col("width") * font / size).otherwise(F.hypot(at(0), at(1)))
    rows = rows.withColumns({"_f": font, "_w": F.greatest(width, F.lit(1.0))}).where(finite(F.col("_f"), F.col("_w"), at(4), at(5)) & (F.col("_f") > 0))
    top = at(5) - F.col("_f") * (rise + margin)
    return rows.withColumns({"x0": at(4), "y0": top, "x1": at(4) + F.col("_w"), "y1": top + F.greatest(F.col("_f") * (1 + 2 * margin), F.lit(1.0))}).drop("_t", "_f", "_w")


def pages_of(redactions: DataFrame, page_col: str = "page") -> DataFrame:
    """Rectangles with a page number of 1 or more."""
    return redactions.withColumn(page_col, F.col(page_col).try_cast("int")).where(F.col(page_col) >= 1)


def recognised_words(blocks: DataFrame, keys: list[str], scale: float = 1.0, blocks_col: str = "blocks") -> DataFrame:
    """keys, block, paragraph, line, word, line_id, text, confidence (0 to 100) and box of every word of nested recognition results.

    ``blocks``: array<struct<paragraphs: array<struct<lines: array<struct<text, confidence, box, words: array<struct<text, confidence, box>>>>>>>>
    with boxes struct<x0, y0, x1, y1>. Words without text or area go.
    """
    deep = blocks.select(*keys, F.posexplode(blocks_col).alias("block", "_b"))
    deep = deep.select(*keys, "block", F.posexplode("_b.paragraphs").alias("paragraph", "_p"))
    deep = deep.select(*keys, "block", "paragraph", F.posexplode("_p.lines").alias("line", "_l"))
    deep = deep.select(*keys, "block", "paragraph", "line", F.posexplode("_l.words").alias("word", "_w"))
    made = deep.select(*keys, "block", "paragraph", "line", "word", F.concat_ws("-", "block", "paragraph", "line").alias("line_id"), T.sanitize_token(F.col("_w.text")).alias("text"), _share(F.col("_w.confidence")).alias("confidence"), *[(F.col(f"_w.box.{c}") / scale).alias(c) for c in BOX])
    return made.where((F.col("text") != "") & _solid())


def recognised_lines(blocks: DataFrame, keys: list[str], scale: float = 1.0, blocks_col: str = "blocks") -> DataFrame:
    """keys, block, paragraph, line, line_id, text, confidence and box of every line; confidence is the mean of its words', else its own."""
    deep = blocks.select(*keys, F.posexplode(blocks_col).alias("block", "_b"))
    deep = deep.select(*keys, "block", F.posexplode("_b.paragraphs").alias("paragraph", "_p"))
    deep = deep.select(*keys, "block", "paragraph", F.posexplode("_p.lines").alias("line", "_l"))
    good = F.filter(F.col("_l.words"), lambda w: (T.sanitize_token(w["text"]) != "") & (w["box"]["x1"] > w["box"]["x0"]) & (w["box"]["y1"] > w["box"]["y0"]))
    mean = F.aggregate(good, F.lit(0.0), lambda s, w: s + _share(w["confidence"])) / F.nullif(F.size(good), F.lit(0))
    made = deep.select(*keys, "block", "paragraph", "line", F.concat_ws("-", "block", "paragraph", "line").alias("line_id"), T.sanitize_line(F.col("_l.text")).alias("text"), F.coalesce(mean, _share(F.col("_l.confidence"))).alias("confidence"), *[(F.col(f"_l.box.{c}") / scale).alias(c) for c in BOX])
    return made.where((F.col("text") != "") & _solid())


def _share(confidence: Column) -> Column:
    value = confidence.cast("double")
    return F.when(finite(value), F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)


def _solid() -> Column:
    return finite(*[F.col(c) for c in BOX]) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
