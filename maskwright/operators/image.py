"""Numeric preparation of gray images before text recognition: array functions over many images at once.

Images are rows (width, height, pixels: row-major bytes); each operator is a vectorised map, so a partition holds a
batch of images and never more. Statistics need no Python at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.joins import meet

# Window, strength and range of the local threshold, contrast scale, percentiles of the stretch.
WINDOW, K, RANGE, CONTRAST, STRETCH = 25, 0.18, 128.0, 48.0, (0.05, 0.95)
# Where pixels count as bright or dark glyphs, and the least span of the stretch.
BRIGHT, DARK, LEAST_SPAN = 168, 88, 24
# A blur's radius and a mosaic's cell where none is named.
BLUR, CELL = 10.0, 8


def gray_stats(pixels: Column) -> Column:
    """struct<min,max,mean,sd,foreground> of an array of gray values; foreground is the share darker than 128."""
    values = F.transform(pixels, lambda p: p.cast("double"))
    n = F.size(values)
    total = lambda f: F.aggregate(values, F.lit(0.0), lambda s, p: s + f(p))
    mean = total(lambda p: p) / n
    spread = F.sqrt(F.greatest(total(lambda p: p * p) / n - mean * mean, F.lit(0.0)))
    dark = total(lambda p: F.when(p < 128, 1.0).otherwise(0.0)) / n
    return F.when(n > 0, F.struct(F.array_min(values).alias("min"), F.array_max(values).alias("max"), mean.alias("mean"), spread.alias("sd"), dark.alias("foreground")))


def collapsed(stats: Column) -> Column:
    """Whether nearly all pixels fell on one side."""
    return (stats["foreground"] <= 0.005) | (stats["foreground"] >= 0.995)


def luma(rgba: np.ndarray) -> np.ndarray:
    return rgba[..., 0] * 0.299 + rgba[..., 1] * 0.587 + rgba[..., 2] * 0.114


def local_moments(gray: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation around every pixel from summed-area tables, windows cut at the border."""
    h, w = gray.shape
    r = window // 2
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    count = (y1 - y0)[:, None] * (x1 - x0)[None, :]

    def box(values: np.ndarray) -> np.ndarray:
        table = np.zeros((h + 1, w + 1))
        table[1:, 1:] = values.cumsum(0).cumsum(1)
        return table[y1][:, x1] - table[y0][:, x1] - table[y1][:, x0] + table[y0][:, x0]

    mean = box(gray) / count
    return mean, np.sqrt(np.maximum(box(gray * gray) / count - mean * mean, 0))


def normalize_contrast(gray: np.ndarray) -> np.ndarray:
    mean, sd = local_moments(gray)
    return np.clip(128 + (gray - mean) * CONTRAST / (sd + 4), 0, 255)


def prefer_dark_glyphs(gray: np.ndarray) -> np.ndarray:
    """Inverted where more pixels are clearly bright than clearly dark; what becomes of fractions is as bytes have it."""
    return np.trunc(255 - gray) if (gray >= BRIGHT).sum() > (gray <= DARK).sum() else gray


def sauvola(gray: np.ndarray) -> np.ndarray:
    mean, sd = local_moments(gray)
    return np.where(gray < mean * (1 + K * (sd / RANGE - 1)), 0.0, 255.0)


def stretch(gray: np.ndarray) -> np.ndarray:
    """Linear stretch between two order statistics of every eighth pixel."""
    seen = np.sort(gray.ravel()[::8])
    lo, hi = (seen[int(q * len(seen))] for q in STRETCH)
    return np.clip(np.floor((gray - lo) / max(LEAST_SPAN, hi - lo) * 255 + 0.5), 0, 255)


def upscale(gray: np.ndarray, factor: int = 3) -> np.ndarray:
    return gray.repeat(factor, 0).repeat(factor, 1)


def pixelate(gray: np.ndarray, cell: int) -> np.ndarray:
    """Mosaic of nearest values; cells of two pixels at least."""
    cell = max(2, cell)
    return upscale(gray[::cell, ::cell], cell)[: gray.shape[0], : gray.shape[1]]


VARIANTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "adaptive": lambda g: sauvola(prefer_dark_glyphs(normalize_contrast(g))),
    "contrast": lambda g: stretch(prefer_dark_glyphs(normalize_contrast(g))),
    "inverted": lambda g: 255 - sauvola(prefer_dark_glyphs(normalize_contrast(g))),
    "upscaled": upscale,
}


def prepare(images: DataFrame, variant: str, id_col: str = "id") -> DataFrame:
    """id, width, height and pixels of one variant of every image; an image whose bytes don't fit its size has an error."""
    make = VARIANTS[variant]
    return _each(_images(images, id_col), lambda gray, _: make(gray.astype(np.float64)))


def clamp(value: float, least: float, most: float) -> float:
    return max(least, min(most, value))


def shrunk(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means on a coarser grid: differences of a summed-area table at cell borders, between pixels in proportion."""
    table = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    table[1:, 1:] = gray.cumsum(0).cumsum(1)
    ys, xs = np.linspace(0, gray.shape[0], height + 1), np.linspace(0, gray.shape[1], width + 1)
    rows = _between(table, ys, 0)
    at = _between(rows, xs, 1)
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return sums / np.outer(np.diff(ys), np.diff(xs))


def _between(values: np.ndarray, places: np.ndarray, axis: int) -> np.ndarray:
    low = np.minimum(places.astype(int), values.shape[axis] - 1)
    high, part = np.minimum(low + 1, values.shape[axis] - 1), places - low
    part = part[:, None] if axis == 0 else part[None, :]
    return values.take(low, axis) * (1 - part) + values.take(high, axis) * part


def stretched(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Values between the middles of cells in proportion, those of the outer cells beyond them."""
    at = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    return _between(_between(gray, at(gray.shape[0], height), 0), at(gray.shape[1], width), 1)


def box_blur(gray: np.ndarray, radius: int) -> np.ndarray:
    """Means over squares, border values going on beyond the border: rows, then columns, by running sums."""
    for axis in (0, 1):
        wide = np.pad(gray, [(radius + 1, radius) if k == axis else (0, 0) for k in (0, 1)], mode="edge").cumsum(axis)
        n = gray.shape[axis]
        gray = (wide.take(range(2 * radius + 1, 2 * radius + 1 + n), axis) - wide.take(range(n), axis)) / (2 * radius + 1)
    return gray


def soft_blur(gray: np.ndarray, sigma: float) -> np.ndarray:
    """Near a bell curve of deviation ``sigma``: three box blurs of its spread."""
    radius = max(1, int(round((np.sqrt(4 * sigma * sigma + 1) - 1) / 2)))
    for _ in range(3):
        gray = box_blur(gray, radius)
    return gray


def stable_blur(gray: np.ndarray, strength: float = BLUR) -> np.ndarray:
    """A region from which no letter can be read: sampled coarsely, its contrast taken back, stretched over the region's edge and blurred, twice if strong.

    Nothing but the region's own pixels goes into it, so a picture and its tiles give the same.
    """
    height, width = gray.shape
    power = clamp(clamp(strength, 1, 50) * clamp(height / 70, 0.8, 2), 1, 80)
    coarse = clamp(1 + power / 7, 1.25, 10)
    small = shrunk(gray.astype(np.float64), max(2, int(height / coarse + 0.5)), max(2, int(width / coarse + 0.5)))
    if power >= 16:
        small = 127.5 + (small - 127.5) * (1 - clamp((power - 14) * 0.85, 6, 40) / 100)
    sigma = clamp(power * 0.7, 6, 34)
    edge = int(min(sigma * 2, min(height, width) * 0.35))
    cut = lambda v, e: v[e : e + height, e : e + width]
    out = cut(soft_blur(stretched(small, height + 2 * edge, width + 2 * edge), sigma), edge)
    if power >= 22:
        out = cut(soft_blur(stretched(out, height + 2 * (edge // 2), width + 2 * (edge // 2)), max(4, sigma * 0.45)), edge // 2)
    return np.clip(out, 0, 255)


def rectangle_lists(rectangles: DataFrame, id_col: str = "id") -> DataFrame:
    """id and ``boxes``: the rectangles of each picture, as ``burn`` reads them."""
    given = {"style": F.lit("blackout"), "strength": F.lit(None).cast("double")}
    rows = rectangles.withColumns({c: v for c, v in given.items() if c not in rectangles.columns}).where("w > 0 and h > 0")
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.collect_set(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], "style", F.col("strength").cast("double").alias("strength"))).alias("boxes"))


def painted(image: np.ndarray, boxes: list) -> np.ndarray:
    """The picture with its rectangles covered, as ``burn`` says."""
    out = image.copy()
    for b in sorted(boxes, key=lambda b: (b["style"] not in ("blur", "pixelate"), b["y"], b["x"], b["h"], b["w"], b["style"] or "", b["strength"] or 0.0)):
        x0, y0 = max(0, int(np.floor(b["x"]))), max(0, int(np.floor(b["y"])))
        at = np.s_[y0 : max(0, int(np.ceil(b["y"] + b["h"]))), x0 : max(0, int(np.ceil(b["x"] + b["w"])))]
        part = image[at]
        if not part.size:
            continue
        if b["style"] == "blur":
            out[at] = np.rint(stable_blur(part, b["strength"] or BLUR))
        elif b["style"] == "pixelate":
            out[at] = pixelate(part, int(b["strength"] or CELL))
        else:
            out[at] = 0
    return out


def burnt(rows: DataFrame, draw: Callable[[dict], np.ndarray], measure: Callable[[np.ndarray], tuple[int, ...]], names: list[str], id_col: str = "id") -> DataFrame:
    """``burn`` for pictures that are made from rows and of which only figures are wanted: the id and ``names``, whole numbers that ``measure`` gives of what
    ``draw(row)`` gives with the row's ``boxes`` (as of ``rectangle_lists``) covered.

    No picture leaves its task or stands beside another there: batches are of rows without pixels, so memory doesn't grow with the rows of a task.
    """

    def over(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = [(row[id_col], *measure(painted(draw(row), row["boxes"] or []))) for row in batch.slice(start, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[id_col, *names])

    return rows.select(id_col, "boxes").mapInArrow(over, ", ".join(f"{c} long" for c in [id_col, *names]))


def burn(images: DataFrame, rectangles: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """``images`` with every rectangle (id, x, y, w, h in pixels) covered, and ``error`` where the bytes don't fit the size.

    ``rectangles`` may name a ``style`` (blackout, which is also what others are taken for; blur; pixelate) and its ``strength``, a blur's radius or a
    mosaic's cell. Blurs and mosaics are made of the picture as it was; black goes over all. Rectangles are gathered for each image, whose
    own size bounds how many matter. Null ids are one id. Without ``rectangles`` the images carry them, as ``rectangle_lists`` gives them, and
    pixels aren't moved.
    """

    rows = _images(images, id_col, "boxes") if rectangles is None else meet(_images(images, id_col), rectangle_lists(rectangles, id_col), ["id"], "left")
    return _each(rows, lambda image, row: painted(image, row.get("boxes") or []))


def _images(images: DataFrame, id_col: str, *carried: str) -> DataFrame:
    return images.select(F.col(id_col).cast("long").alias("id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels", *carried)


def _each(images: DataFrame, make: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """id, width, height, pixels and error: ``make(gray, row)`` of every image, batch by batch; an image whose bytes don't fit its size has an error."""

    def over(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                out = []
                for row in batch.slice(start, 16).to_pylist():
                    raw, size = row["pixels"], (row["height"], row["width"])
                    if raw is None or None in size or min(size) < 1 or len(raw) != size[0] * size[1]:
                        out.append((row["id"], row["width"], row["height"], None, "pixels do not fit the size"))
                        continue
                    done = make(np.frombuffer(raw, np.uint8).reshape(size), row)
                    out.append((row["id"], done.shape[1], done.shape[0], np.rint(done).astype(np.uint8).tobytes(), None))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", "width", "height", "pixels", "error"])

    return images.mapInArrow(over, "id long, width int, height int, pixels binary, error string")
