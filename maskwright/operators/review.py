"""Review policy: how far a detection was validated, what a reader is warned of, and what may be covered unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import checks, fixed

REVIEW_HINTS = ["vkn_unverified", "custom_id", "short_secret", "passport_unlabeled", "ssn_unlabeled", "routing_unverified", "seed", "iban_pattern_only"]


def add_review(detections: DataFrame, confidence_col: str | None = None) -> DataFrame:
    """``detections`` with validation, warnings and the review flags; without a confidence column none is low."""
    kind, text = F.col("type"), F.col("text")
    hint = F.when(kind == "seed_phrase", "seed").when((kind == "env_secret") & (F.length(text) < 8), "short_secret").otherwise(F.col("hint"))
    confidence = F.col(confidence_col).cast("double") if confidence_col else F.lit(None).cast("double")
    rows = detections.withColumns({"_hint": hint, "_tckn_bad": (kind == "tckn") & ~checks.tckn(text), "_cut": (kind == "api_token") & checks.truncated_credential(text)})
    flagged, bad = F.col("_hint").isin(REVIEW_HINTS), F.col("_tckn_bad")
    contextual, low = kind.isin("person_name", "location"), F.coalesce(confidence < fixed.LOW_CONFIDENCE, F.lit(False))
    validation = (
        F.when(F.coalesce(flagged, F.lit(False)), "unverified")
        .when(F.col("iban_checksum_valid") | kind.isin("credit_card", "routing_number") | ((kind == "tckn") & ~bad), "checksum")
        .when(F.col("iban_checksum_failed"), "unverified")
        .when(contextual | bad | F.col("carrier_skipped"), "contextual")
        .when(kind.isin(fixed.PATTERN_TYPES), "pattern")
        .otherwise("unverified")
    )
    causes = {h: F.col("_hint") == h for h in REVIEW_HINTS} | {"iban_failed": F.col("iban_checksum_failed"), "tckn_failed": bad, "carrier_skipped": F.col("carrier_skipped"), "ocr_corrected": F.col("ocr_corrected"), "truncated": F.col("_cut"), "contextual": contextual, "low_ip": low & kind.isin("ipv4", "ipv6"), "low": low & ~kind.isin("ipv4", "ipv6")}
    warnings = F.filter(F.array(*[F.when(causes[name], F.lit(said)) for name, said in fixed.WARNINGS]), lambda w: w.isNotNull())
    needs = F.coalesce(flagged, F.lit(False))
    return rows.withColumns({
        "confidence": confidence,
        "validation": validation,
        "warnings": warnings,
        "label_based": F.col("labeled") | (kind == "location") | bad,
        "truncated": F.col("_cut"),
        "needs_review": needs,
        "pattern_matched": needs & (F.col("_hint") != "vkn_unverified"),
        "low_confidence": F.coalesce(F.col("_hint") == "vkn_unverified", F.lit(False)),
    }).drop("_hint", "_tckn_bad", "_cut")


def automatic(detections: DataFrame, confirmed: bool = False) -> DataFrame:
    """What may be covered without a reader; everything once confirmed."""
    return detections if confirmed else detections.where(~F.col("needs_review"))


def in_profile(detections: DataFrame) -> DataFrame:
    return detections.where(F.col("type").isin(fixed.PROFILE + fixed.ALWAYS_ON) | (F.col("rule_id") == "iban"))


def for_tool(detections: DataFrame, allowed: list[str]) -> DataFrame:
    """Types that a tool shows, those that are always shown, and account numbers; an empty list shows all."""
    if not allowed:
        return detections
    return detections.where(F.col("type").isin(allowed + fixed.ALWAYS_ON) | F.coalesce(F.col("rule_id") == "iban", F.lit(False)))


def tools_table(spark) -> DataFrame:
    """slug and type of every preset."""
    return spark.createDataFrame([(slug, kind) for slug, kinds in fixed.TOOLS.items() for kind in kinds], "slug string, type string")


def for_tools(detections: DataFrame, tools: DataFrame) -> DataFrame:
    """Each tool's view of the detections: a join with the presets, a few rows of fixed size."""
    slugs = F.broadcast(tools.select("slug").distinct())
    shown = detections.where(F.col("type").isin(fixed.ALWAYS_ON) | F.coalesce(F.col("rule_id") == "iban", F.lit(False))).crossJoin(slugs)
    picked = detections.where(~F.col("type").isin(fixed.ALWAYS_ON) & ~F.coalesce(F.col("rule_id") == "iban", F.lit(False))).join(F.broadcast(tools), "type")
    return shown.unionByName(picked)
