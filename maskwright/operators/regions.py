"""Regions of pictures that are worth a second reading: where they lie, crops of them, and the way back to the picture.

A picture is a row (id, width, height, pixels): row-major bytes, one a pixel for gray and four for RGBA. One picture gives up to three region
rows; crops carry their region's corner and scale, which is the whole map back. Work within a picture is arrays over its pixels; everything between
pictures, boxes and words is joins.

What belongs to a picture (regions, boxes read already) is gathered into an array by its id. Pictures may carry that array as a column, met before their
pixels are read or made, so that no pixels are shuffled; where it comes as a table of its own it meets the pictures, which are never broadcast.

Defined results: a picture whose bytes don't fit its size gives one row with ``error`` and nothing else; null ids are one id; a crop that
reaches over the picture is cut to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import checks, fixed
from maskwright.operators.image import luma
from maskwright.operators.joins import meet
from maskwright.operators.spatial import BOX

# Cells of 8 pixels whose mean and deviation mark a badge, how far marks spread, the least and greatest size of a region,
# what is added around it, and how many a picture has at most.
CELL, MARK_MEAN, MARK_SD, SPREAD = 8, (28, 150), (1.2, 36), 2
LEAST_CELLS, LEAST_SIZE, MOST_SHARE, PAD, MOST = 4, (36, 16), 0.35, 28, 3
# Gray values that tell a badge's own tone, how near a column has to be to it, what is added at its sides, and the most it may take.
TONE, NEAR_TONE, COLUMN_TONE, COLUMN_SHARE, SIDE, MOST_GROWN = (28, 170), 36, (20, 180), 0.5, 48, 0.5
# Regions on one row (by their tops) that share so much of the smaller are one.
SAME_ROW, SAME_SHARE = 15, 0.6
# Fixed values of text bands: the most that a pixel counts, the least peaks, the radii of smoothing, the cut below a peak, and what is added.
MOST_ACTIVITY, ROW_PEAK, ROW_RADIUS, ROW_CUT, ROW_PAD = 14, 8, 3, 0.45, 8
COLUMN_PEAK, COLUMN_RADIUS, COLUMN_CUT, COLUMN_GAP, COLUMN_PAD = 12, 22, 0.16, 48, 40
BADGE_PAD = 120
SECOND_LINES, SECOND_CONFIDENCE = 1000, 90.0


def gray_of(raw: bytes, width: int, height: int) -> np.ndarray | None:
    """Gray values of a picture's bytes; None where they don't fit its size."""
    if raw is None or width is None or height is None or width < 1 or height < 1 or len(raw) not in (width * height, 4 * width * height):
        return None
    flat = np.frombuffer(raw, np.uint8).astype(np.float64)
    return flat.reshape(height, width) if len(raw) == width * height else luma(flat.reshape(height, width, 4))


def _smooth(scores: np.ndarray, radius: int) -> np.ndarray:
    """Means over windows cut at the ends, in single precision."""
    at, n = np.arange(len(scores)), len(scores)
    lo, hi = np.maximum(at - radius, 0), np.minimum(at + radius + 1, n)
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    return ((total[hi] - total[lo]) / (hi - lo)).astype(np.float32)


def strongest_band(scores: np.ndarray, floor: float, radius: int) -> tuple[int, int] | None:
    """(first, last) of the run over the cut with the greatest sum; None where no peak reaches ``floor``."""
    smooth = _smooth(scores, radius)
    if not len(smooth) or smooth.max() < floor:
        return None
    on = np.concatenate([[0], (smooth >= smooth.max() * ROW_CUT).astype(np.int8), [0]])
    first, last = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1) - 1
    sums = np.concatenate([[0.0], np.cumsum(smooth, dtype=np.float64)])
    best = int(np.argmax(sums[last + 1] - sums[first]))
    return int(first[best]), int(last[best])


def column_span(scores: np.ndarray, pad: int = COLUMN_PAD) -> tuple[int, int] | None:
    """(first, last) grown from the highest peak over gaps of ``COLUMN_GAP`` columns at most; None without a peak."""
    smooth = _smooth(scores, COLUMN_RADIUS)
    if not len(smooth) or smooth.max() < COLUMN_PEAK:
        return None
    peak = int(np.argmax(smooth))
    on = np.unique(np.append(np.flatnonzero(smooth >= smooth[peak] * COLUMN_CUT), peak))
    far = np.flatnonzero(np.diff(on) > COLUMN_GAP + 1)  # where the growth stops
    at = int(np.searchsorted(on, peak))
    left, right = far[far < at], far[far >= at]
    start, end = on[left[-1] + 1] if len(left) else on[0], on[right[0]] if len(right) else on[-1]
    return max(0, int(start) - pad), min(len(scores) - 1, int(end) + pad)


def activity(gray: np.ndarray) -> np.ndarray:
    """What a pixel differs from its left and upper neighbour, ``MOST_ACTIVITY`` at most; nothing in the first row and column."""
    out = np.zeros(gray.shape)
    inner = gray[1:, 1:]
    out[1:, 1:] = np.minimum(MOST_ACTIVITY, np.abs(inner - gray[1:, :-1]) + np.abs(inner - gray[:-1, 1:]))
    return out


def row_scores(gray: np.ndarray) -> np.ndarray:
    """By row, the activity over the row's median, at every fourth pixel."""
    seen = activity(gray)[:, 1::4]
    if not seen.shape[1]:
        return np.zeros(len(gray), np.float32)
    median = np.sort(seen, 1)[:, seen.shape[1] // 2]
    scores = np.maximum(seen - median[:, None], 0).sum(1)
    scores[0] = 0
    return scores.astype(np.float32)


def column_scores(gray: np.ndarray, top: int, bottom: int) -> np.ndarray:
    return activity(gray)[max(1, top) : bottom + 1].sum(0).astype(np.float32)


def text_band(gray: np.ndarray) -> tuple[int, int, int, int]:
    """(x, y, width, height) of the strongest band of text; the whole picture where there is none, or little to cut off."""
    height, width = gray.shape
    whole = (0, 0, width, height)
    if height < 8 or width < 8:
        return whole
    rows = strongest_band(row_scores(gray), ROW_PEAK, ROW_RADIUS)
    top, bottom = (max(0, rows[0] - ROW_PAD), min(height - 1, rows[1] + ROW_PAD)) if rows else (0, height - 1)
    across = column_span(column_scores(gray, top, bottom))
    if not rows and not across:
        return whole
    left, right = across or (0, width - 1)
    if right - left + 1 >= width - 2 and bottom - top + 1 >= height - 2:
        return whole
    return left, top, right - left + 1, bottom - top + 1


def _marked(gray: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Cells whose tone is a badge's and whose middle no box covers, and those near them."""
    height, width = gray.shape
    ys, xs = np.arange(0, height, CELL), np.arange(0, width, CELL)
    ye, xe = np.minimum(ys + CELL, height), np.minimum(xs + CELL, width)
    summed = lambda v: np.add.reduceat(np.add.reduceat(v, ys, 0), xs, 1)
    n = (ye - ys)[:, None] * (xe - xs)[None, :]
    mean = summed(gray) / n
    sd = np.sqrt(np.maximum(summed(gray * gray) / n - mean * mean, 0))
    on = (mean >= MARK_MEAN[0]) & (mean <= MARK_MEAN[1]) & (sd >= MARK_SD[0]) & (sd <= MARK_SD[1])
    cy, cx = ((ys + ye) / 2)[:, None], ((xs + xe) / 2)[None, :]
    for x0, y0, x1, y1 in covered:
        on &= ~((cx >= x0) & (cx <= x1) & (cy >= y0) & (cy <= y1))
    padded, out = np.pad(on, SPREAD), np.zeros_like(on)
    for dy in range(2 * SPREAD + 1):
        for dx in range(2 * SPREAD + 1):
            out |= padded[dy : dy + on.shape[0], dx : dx + on.shape[1]]
    return out


def _components(on: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(first row, first column, last row, last column, cells) of each connected part, in the order of their first cells."""
    none = on.size
    label = np.where(on, np.arange(none).reshape(on.shape), none)
    while True:
        low = np.pad(label, 1, constant_values=none)
        new = np.where(on, np.minimum.reduce([label, low[:-2, 1:-1], low[2:, 1:-1], low[1:-1, :-2], low[1:-1, 2:]]), none)
        # A label that has moved on is followed to where it has moved since.
        flat = np.append(new.ravel(), none)
        new = np.where(on, flat[new], none)
        if (new == label).all():
            break
        label = new
    rows, columns = np.nonzero(on)
    out = []
    for part in np.unique(label[on]):
        mine = label[rows, columns] == part
        out.append((int(rows[mine].min()), int(columns[mine].min()), int(rows[mine].max()), int(columns[mine].max()), int(mine.sum())))
    return out


def grown_to_badge(gray: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[int, int, int, int]:
    """A region as wide as the columns beside it have its own tone, and a side on top; itself where that takes half of the picture."""
    height, width = gray.shape
    x1, y1 = min(width, x + max(1, w)), min(height, y + max(1, h))
    seen = np.sort(gray[y:y1:2, x:x1:2], axis=None)
    seen = seen[(seen >= TONE[0]) & (seen <= TONE[1])]
    if not len(seen):
        return x, y, w, h
    tone, band = seen[len(seen) // 2], gray[y:y1:2]
    alike = ((np.abs(band - tone) <= NEAR_TONE) & (band >= COLUMN_TONE[0]) & (band <= COLUMN_TONE[1])).mean(0) >= COLUMN_SHARE
    stop_left, stop_right = np.flatnonzero(~alike[:x]), np.flatnonzero(~alike[x1:])
    left = (int(stop_left[-1]) + 1 if len(stop_left) else 0) if x > 0 else 0
    right = x1 - 1 + (int(stop_right[0]) if len(stop_right) else width - x1)
    left, right = max(0, left - SIDE), min(width - 1, right + SIDE)
    return (x, y, w, h) if (right - left + 1) * (y1 - y) > width * height * MOST_GROWN else (left, y, right - left + 1, y1 - y)


def regions_of(gray: np.ndarray, covered: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of a picture's regions, the largest first."""
    height, width = gray.shape
    found = []
    for top, left, bottom, right, cells in _components(_marked(gray, covered)):
        w, h = (right - left + 1) * CELL, (bottom - top + 1) * CELL
        if cells < LEAST_CELLS or w < LEAST_SIZE[0] or h < LEAST_SIZE[1] or w * h > width * height * MOST_SHARE:
            continue
        x, y = max(0, left * CELL - PAD), max(0, top * CELL - PAD)
        found.append(grown_to_badge(gray, x, y, min(width, (right + 1) * CELL + PAD) - x, min(height, (bottom + 1) * CELL + PAD) - y))
    kept: list[tuple[int, int, int, int]] = []
    for r in sorted(found, key=lambda r: -r[2] * r[3]):
        if not any(_same_region(k, r) for k in kept):
            kept.append(r)
    return kept[:MOST]


def _same_region(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> bool:
    w, h = (max(0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    return abs(a[1] - b[1]) <= SAME_ROW and w * h > SAME_SHARE * min(a[2] * a[3], b[2] * b[3])


_REGION = [("region", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32())]


def _pictures(images: DataFrame, id_col: str, *carried: str) -> DataFrame:
    return images.select(F.col(id_col).cast("long").alias("id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels", *carried)


def covered_lists(covered: DataFrame, id_col: str = "id") -> DataFrame:
    """id and ``covered``: the boxes (id, x0..y1) of each picture."""
    return covered.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in BOX])).alias("covered"))


def region_lists(regions: DataFrame) -> DataFrame:
    """id and ``regions``: the regions (id, region, x, y, width, height) of each picture, in their order."""
    region = F.struct("region", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    return regions.where("region is not null").groupBy("id").agg(F.sort_array(F.collect_list(region)).alias("regions"))


def _over_pictures(pictures: DataFrame, fields: list[tuple[str, pa.DataType]], schema: str, make, wanted=lambda row: True) -> DataFrame:
    """id, ``fields`` and error: the rows that ``make(gray, row)`` gives for each picture that is ``wanted``, few pictures at a time."""
    kinds = [("id", pa.int64()), *fields, ("error", pa.string())]

    def over(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                out = []
                for row in batch.slice(start, 16).to_pylist():
                    if not wanted(row):
                        continue
                    gray = gray_of(row["pixels"], row["width"], row["height"])
                    if gray is None:
                        out.append((row["id"], *[None] * len(fields), "pixels do not fit the size"))
                        continue
                    out += [(row["id"], *found, None) for found in make(gray, row)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    return pictures.mapInArrow(over, f"id long, {schema}, error string")


def find_regions(images: DataFrame, covered: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """id, region (from 0, the largest first), x, y, width, height and error. ``covered``: boxes (id, x0..y1) that were read already.

    Without it ``images`` may carry them, as ``covered_lists`` gives them.
    """
    rows = _pictures(images, id_col, *[c for c in ("covered",) if covered is None and c in images.columns])
    if covered is not None:
        rows = meet(rows, covered_lists(covered, id_col), ["id"], "left")
    make = lambda gray, row: [(k, *r) for k, r in enumerate(regions_of(gray, np.array(row.get("covered") or [], float).reshape(-1, 4)))]
    return _over_pictures(rows, _REGION, "region int, x int, y int, width int, height int", make)


def text_bands(images: DataFrame, id_col: str = "id") -> DataFrame:
    """id, region (0), x, y, width, height and error: where each picture's strongest band of text lies, for ``crops``."""
    return _over_pictures(_pictures(images, id_col), _REGION, "region int, x int, y int, width int, height int", lambda gray, _: [(0, *text_band(gray))])


def profiles(images: DataFrame, id_col: str = "id") -> DataFrame:
    """id, rows, columns (the projection profiles that bands are sought in) and error."""
    fields = [("rows", pa.list_(pa.float64())), ("columns", pa.list_(pa.float64()))]
    make = lambda gray, _: [(row_scores(gray).astype(float), column_scores(gray, 0, len(gray) - 1).astype(float))]
    return _over_pictures(_pictures(images, id_col), fields, "rows array<double>, columns array<double>", make)


def crops(images: DataFrame, regions: DataFrame | None = None, scale: int = 1, rgba: bool = False, id_col: str = "id") -> DataFrame:
    """id, region, x, y, scale, width, height, pixels and error: each region (id, region, x, y, width, height) cut out and scaled up by whole pixels.

    Pixels stay gray or RGBA as they were; ``rgba`` makes gray ones opaque RGBA. Regions meet their picture as one array, so pixels are moved once;
    without ``regions`` the pictures carry them, as ``region_lists`` gives them, and pixels aren't moved at all. Pictures without regions have no rows.
    """
    if scale < 1:
        raise ValueError("crops are scaled up by whole numbers")
    # Only the right side of a left join can be broadcast: the planner takes pictures for as small as the rows that they are made of.
    rows = _pictures(images, id_col, "regions") if regions is None else meet(_pictures(images, id_col), region_lists(regions), ["id"], "left")
    return _over_pictures(rows, _CROP, _CROP_TYPES, lambda _, row: _cut(row, [(r["region"], r["x"], r["y"], r["width"], r["height"]) for r in row["regions"]], scale, rgba), lambda row: row["regions"] is not None)


def band_crops(images: DataFrame, scale: int = 1, rgba: bool = False, id_col: str = "id") -> DataFrame:
    """``crops`` of the bands that ``text_bands`` finds, in one pass over the pictures; those whose bytes don't fit their size have no rows."""
    if scale < 1:
        raise ValueError("crops are scaled up by whole numbers")
    return _over_pictures(_pictures(images, id_col), _CROP, _CROP_TYPES, lambda gray, row: _cut(row, [(0, *text_band(gray))], scale, rgba), lambda row: gray_of(row["pixels"], row["width"], row["height"]) is not None)


_CROP = [("region", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("scale", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]
_CROP_TYPES = "region int, x int, y int, scale int, width int, height int, pixels binary"


def _cut(row: dict, regions: list[tuple], scale: int, rgba: bool):
    """A picture's regions (number, x, y, width, height), cut to it and scaled up."""
    raw = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], -1)
    for region, left, top, width, height in regions:
        x, y = max(0, int(np.floor(left))), max(0, int(np.floor(top)))
        part = raw[y : y + max(1, int(np.floor(height))), x : x + max(1, int(np.floor(width)))]
        if not part.size:
            continue
        if rgba and part.shape[2] == 1:
            part = np.concatenate([part.repeat(3, 2), np.full((*part.shape[:2], 1), 255, np.uint8)], 2)
        part = part.repeat(scale, 0).repeat(scale, 1)
        yield region, x, y, scale, part.shape[1], part.shape[0], part.tobytes()


def in_picture(boxes: DataFrame) -> DataFrame:
    """``boxes`` of a crop (x0..y1, with the crop's x, y and scale) at their place in the picture."""
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1)
    return boxes.withColumns({c: F.col("x" if c[0] == "x" else "y") + F.col(c) / scale for c in BOX})


def relocated(words: DataFrame, cut: DataFrame, keys: list[str]) -> DataFrame:
    """Words read in crops (``keys``, region, line_index, line_id, x0..y1, ...) as words of the picture, on lines of their own, with source_pass.

    ``cut``: the crops' keys, region, x, y and scale.
    """
    on = [*keys, "region"]
    placed = in_picture(meet(words, cut.select(*on, "x", "y", "scale"), on)).drop("x", "y", "scale")
    return placed.withColumns({"line_id": F.concat(F.lit("p2-"), "line_id"), "line_index": F.col("line_index") + SECOND_LINES, "source_pass": F.lit("pass2")})


def lines_of(words: DataFrame) -> DataFrame:
    """Each word as a line of its own: id, text, confidence, box and the word in ``words``."""
    return words.withColumns({"id": F.col("line_id"), "words": F.array(F.struct(*words.columns))})


def padded_badge(boxes: DataFrame, image_width: Column) -> DataFrame:
    """``boxes`` (x, y, width, height) wider by a badge's sides, on the picture."""
    x, w = F.coalesce(F.col("x").cast("double"), F.lit(0.0)), F.coalesce(F.col("width").cast("double"), F.lit(0.0))
    left, right = F.greatest(F.lit(0.0), x - BADGE_PAD), F.least(image_width.cast("double"), x + w + BADGE_PAD)
    return boxes.withColumns({"x": left, "y": F.coalesce(F.col("y").cast("double"), F.lit(0.0)), "width": F.greatest(F.lit(1.0), right - left), "height": F.coalesce(F.col("height").cast("double"), F.lit(0.0))})


def uncovered(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, px, py) that no box (keys, x0..y1) of their picture holds, edges included."""
    held = boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in BOX])
    inside = (F.col("px") >= F.col("_x0")) & (F.col("px") <= F.col("_x1")) & (F.col("py") >= F.col("_y0")) & (F.col("py") <= F.col("_y1"))
    return points.join(held, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], inside], "left_anti")


def second_readings(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``texts`` with ``reading``: what a second reading of a region came to, by the numbers in it."""
    from maskwright.operators.words import second_pass_numbers

    found = second_pass_numbers(texts, keys, text_col).select(*keys).distinct().withColumn("_valid", F.lit(True))
    reading = F.when(F.col("_valid"), fixed.READINGS[0]).when(F.coalesce(F.col(text_col), F.lit("")).rlike("[0-9]{4,}"), fixed.READINGS[1]).otherwise(fixed.READINGS[2])
    return meet(texts, found, keys, "left").withColumn("reading", reading).drop("_valid")


def number_words(numbers: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """A number read in a region (``keys``, region, text) as a word that covers the whole region (``keys``, region, x, y, width, height)."""
    on = [*keys, "region"]
    met = meet(numbers, regions.select(*on, "x", "y", "width", "height"), on)
    x, y = F.coalesce(F.col("x").cast("double"), F.lit(0.0)), F.coalesce(F.col("y").cast("double"), F.lit(0.0))
    whole = lambda c: F.floor(c + 0.5).cast("int")
    side = lambda c: F.greatest(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    boxed = {"x0": x, "y0": y, "x1": x + side("width"), "y1": y + side("height"), "confidence": F.lit(SECOND_CONFIDENCE), "source_pass": F.lit("pass2")}
    named = {"line_id": F.concat(F.lit("p2-roi-y"), whole(y).cast("string"), F.lit("-x"), whole(x).cast("string")), "line_index": F.lit(SECOND_LINES) + whole(y)}
    return met.withColumns(boxed | named).drop("x", "y", "width", "height")


GRID = 64.0
REACH = 20.0  # centres nearer than this are one place
FEW = 32  # words of a page that are compared with each other without cells


def merged_words(first: DataFrame, second: DataFrame, keys: list[str], order_col: str = "ordinal", numbers: bool = True) -> DataFrame:
    """``first`` and those words of ``second`` (both keys, text, x0..y1, ``order_col``) that stand where none was read before, in their order.

    Two identity numbers are one only where their glyphs lie on each other (unless ``numbers`` is false). Rows that are equal in all of this are one.
    Words meet in lists: of a page that holds few, else of each cell that boxes reach into. Words of ``second`` among themselves are taken in order,
    those alone that meet another. All steps go by the page's keys or finer, so rows are shuffled by page and never again.
    """
    from maskwright.operators import spatial

    number = lambda c: (F.size(checks.tckn_evidence(F.coalesce(c, F.lit("")))) == 3) if numbers else F.lit(False)
    box = lambda row: [row[c] for c in BOX]
    same = lambda a, b: F.when(a["_number"] & b["_number"], spatial.same_glyphs(box(a), box(b))).otherwise(spatial.duplicate(box(a), box(b)))
    placed = lambda rows: rows.where(" and ".join(f"{c} is not null and not isnan({c})" for c in BOX)).withColumn("_number", number(F.col("text")))
    page = Window.partitionBy(*keys)
    names = [c for c in second.columns if c not in keys]
    named = placed(second.where(F.trim(F.coalesce("text", F.lit(""))) != "")).withColumn("_id", F.struct(order_col, *BOX, "text"))
    named = named.select(*keys, F.struct("_id", *names, "_number").alias("_w"))
    held = placed(first).select(*keys, F.struct(*BOX, "_number").alias("_f"))
    rows = named.unionByName(held, allowMissingColumns=True)
    repeated = F.col("_w").isNotNull() & F.coalesce(F.lag("_w._id").over(page.orderBy("_w._id")).eqNullSafe(F.col("_w._id")), F.lit(False))
    rows = rows.withColumns({"_again": repeated, "_n": F.count("*").over(page)}).where("not _again")
    at = {c: F.coalesce(f"_w.{c}", f"_f.{c}") for c in BOX}
    span = lambda lo, hi: F.when(F.col("_n") <= FEW, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor((at[lo] - REACH) / GRID), F.floor((F.greatest(at[lo], at[hi]) + REACH) / GRID)))
    celled = rows.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))
    lists = celled.groupBy(*keys, "_cx", "_cy").agg(F.collect_list("_w").alias("_ws"), F.collect_list("_f").alias("_fs"))
    other = lambda w: F.exists("_ws", lambda o: (o["_id"] != w["_id"]) & same(w, o))
    judged = F.transform("_ws", lambda w: F.struct(w.alias("w"), F.exists("_fs", lambda f: same(w, f)).alias("taken"), other(w).alias("crowded")))
    each = lists.select(*keys, F.explode(judged).alias("_j")).groupBy(*keys, F.col("_j.w._id").alias("_id"))
    free = each.agg(F.first("_j.w").alias("_w"), F.max("_j.taken").alias("_taken"), F.max("_j.crowded").alias("_crowded")).where("not _taken")
    # Only words that have another near them need an order.
    ordered = free.groupBy(*keys, F.when(~F.col("_crowded"), F.col("_id")).alias("_alone")).agg(F.sort_array(F.collect_list("_w")).alias("_all"))
    chosen = F.aggregate("_all", F.slice("_all", 1, 0), lambda out, w: F.when(F.exists(out, lambda k: same(k, w)), out).otherwise(F.array_append(out, w)))
    kept = ordered.select(*keys, F.explode(chosen).alias("_w")).select(*keys, *[F.col(f"_w.{c}").alias(c) for c in names])
    return first.unionByName(kept, allowMissingColumns=True)


def first_come(candidates: DataFrame, keys: list[str], order_col: str = "ordinal") -> DataFrame:
    """Candidates in their order, less those that lie where an earlier one was kept."""
    named = candidates.withColumn("text", F.lit("-")) if "text" not in candidates.columns else candidates
    return merged_words(named.limit(0), named, keys, order_col, numbers=False).select(*candidates.columns)
