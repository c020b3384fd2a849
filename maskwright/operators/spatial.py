"""Boxes and what overlaps: duplicates, suppression, and rectangles for redaction.

Boxes are columns x0, y0, x1, y1 (pixels). Every operator works within a page: joins carry the page's keys, so no pair
leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import checks, fixed
from maskwright.functions import text as T

BOX = ["x0", "y0", "x1", "y1"]


def _box(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX]


def area(b: list[Column]) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: list[Column], b: list[Column]) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side(0, 2) * side(1, 3)


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Shared area as a part of the smaller box."""
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1e-8))


def iou(a: list[Column], b: list[Column]) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def duplicate(a: list[Column], b: list[Column]) -> Column:
    """Same place: mostly shared, or centres within 20 pixels, unless on different lines."""
    mid = lambda x, lo, hi: (x[lo] + x[hi]) / 2
    dx, dy = mid(a, 0, 2) - mid(b, 0, 2), mid(a, 1, 3) - mid(b, 1, 3)
    beside = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shorter = F.greatest(F.least(a[3] - a[1], b[3] - b[1]), F.lit(1.0))
    return ~((F.abs(dy) > 10) & (beside < shorter * 0.5)) & ((iou(a, b) > 0.5) | (F.sqrt(dx * dx + dy * dy) < 20))


def same_glyphs(a: list[Column], b: list[Column]) -> Column:
    return (F.abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) < 4) & (iou(a, b) > 0.8)


def is_iban(p: str = "") -> Column:
    return F.coalesce((F.col(f"{p}rule_id") == "iban") | ((F.col(f"{p}type") == "custom_rule") & F.col(f"{p}label").rlike("(?i)iban")), F.lit(False))


def rank(p: str = "") -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.RANKS.items() for x in pair])
    return F.when(is_iban(p), 0).otherwise(F.coalesce(F.try_element_at(table, F.col(f"{p}type")), F.lit(9)))


def is_weak(p: str = "") -> Column:
    """Types that a stronger match over the same place removes."""
    kind = F.col(f"{p}type")
    guarded = is_iban(p) | kind.isin(fixed.NEVER_SUPPRESSED) | ((kind == "credit_card") & checks.luhn(F.col(f"{p}text")))
    return ~guarded & (kind.isin(fixed.WEAK) | F.coalesce((kind == "custom_rule") & (F.col(f"{p}rule_id") == "custom-id"), F.lit(False)))


def suppress(detections: DataFrame, page_keys: list[str], id_col: str = "id") -> DataFrame:
    """``detections`` without weak ones in the shadow of a sound account number or of a better rank.

    All are judged against the full list, so this is one anti-join within the page.
    """
    marked = detections.withColumns({"_weak": is_weak(), "_rank": rank(), "_sound": is_iban() & checks.iban_structure(F.col("text"))})
    weak, strong = marked.where("_weak"), marked.where(F.col("_sound") | (F.col("_rank") < 9))
    others = strong.select(*page_keys, F.col(id_col).alias("_o_id"), F.col("_rank").alias("_o_rank"), F.col("_sound").alias("_o_sound"), *[F.col(c).alias(f"_o_{c}") for c in BOX])
    shadow = (F.col(id_col) != F.col("_o_id")) & (F.col("_o_sound") | (F.col("_o_rank") < F.col("_rank"))) & (overlap(_box(""), _box("_o_")) >= fixed.OVERLAP)
    on = [weak[k].eqNullSafe(others[k]) for k in page_keys]
    kept = weak.join(others, [*on, shadow], "left_anti")
    return kept.unionByName(marked.where(~F.col("_weak"))).drop("_weak", "_rank", "_sound")


def deduplicate(detections: DataFrame, page_keys: list[str]) -> DataFrame:
    """Greedy removal of repeats by type: longest text first, then largest box, then input order (``ordinal``).

    Repeats are of one type, so each type of a page is folded by itself over its detections in that order.
    """
    group = [*page_keys, "type"]
    names = [c for c in detections.columns if c not in group]
    key = F.when(F.col("type") == "person_name", T.name_key(F.col("text"))).otherwise(T.detection_text(F.col("text")))
    item = F.struct((-F.length(T.detection_text(F.col("text")))).alias("_size"), (-area(_box(""))).alias("_area"), F.col("ordinal").alias("_ordinal"), key.alias("_key"), *names)
    finite = F.lit(True)
    for c in BOX:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    pages = detections.where(finite).groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("_all"))
    b = lambda s: [s[c].cast("double") for c in BOX]

    def repeats(k: Column, x: Column) -> Column:
        band = F.greatest(k["y1"] - k["y0"], x["y1"] - x["y0"], F.lit(1e-3))
        near = (F.abs((k["y0"] + k["y1"]) / 2 - (x["y0"] + x["y1"]) / 2) <= band * 0.65) & (F.greatest(k["x0"], x["x0"]) - F.least(k["x1"], x["x1"]) <= band * 1.25)
        kind = F.col("type")
        by_name = (kind == "person_name") & (k["_key"] == x["_key"]) & (x["_key"] != "") & near
        return F.when(kind == "tckn", same_glyphs(b(k), b(x))).otherwise(duplicate(b(k), b(x)) | by_name)

    kept = F.aggregate("_all", F.slice("_all", 1, 0), lambda out, x: F.when(F.exists(out, lambda k: repeats(k, x)), out).otherwise(F.array_append(out, x)))
    return pages.select(*group, F.explode(kept).alias("_d")).select(*[F.col(c) if c in group else F.col(f"_d.{c}").alias(c) for c in detections.columns])


def redactions(detections: DataFrame, style: str = "blackout", width: str = "width", height: str = "height") -> DataFrame:
    """Pixel rectangles clipped to the page, empty ones dropped; styles other than blackout carry their own parameter."""
    if style not in ("blackout", "blur", "pixelate"):
        raise ValueError(f"unknown style {style}")
    x, y = F.greatest(F.col("x0"), F.lit(0.0)), F.greatest(F.col("y0"), F.lit(0.0))
    rows = detections.withColumns({"_x": x, "_y": y, "_w": F.least(F.col("x1"), F.col(width)) - x, "_h": F.least(F.col("y1"), F.col(height)) - y}).where("_w > 0 and _h > 0")
    kept = [c for c in detections.columns if c not in BOX]
    return rows.select(*kept, F.lit(style).alias("style"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_w").alias("w"), F.col("_h").alias("h"), F.lit("#000000" if style == "blackout" else None).alias("color"))


def hardened(redacted: DataFrame) -> DataFrame:
    """Every style as solid black: what a raster copy burns in."""
    return redacted.withColumns({"color": F.when(F.col("style") == "blackout", F.coalesce("color", F.lit("#000000"))).otherwise("#000000"), "style": F.lit("blackout")})
