"""What the findings of the third round say of the search: it runs once for each query, behind tests that are cheap and miss nothing."""

from pyspark.sql import functions as F

from maskwright.functions import detectors
from maskwright.functions import text as T
from maskwright.functions.patterns import spelled
from maskwright.operators import scan
from maskwright.plans import catalog, managed

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a - b", "a-b", "a_ b", "a _b", "a　-b", "a–b", "a ＿ b", "−", "été", "日本語 -x", "x ‐", "O 5", "tel O532", "xO5", "ΟΟ5", "5 о 5", "Ø\n7", "_O5", "12 345 678 9", "1234 5678", "bEaReR", "pay DE12 ", "DE12. x", "Bearer", "in istanbul", "x in  ankara", "xin izmir", "at ankara", "ankara ili", "xankara ili"]


def searches(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Generate inline")


def test_the_search_runs_no_more_than_once(spark):
    assert searches(catalog.QUERIES["placed_detections"](spark, SF)) <= 1
    assert searches(managed.QUERIES["planted_null_keys"](spark, SF)) <= 1


def test_digits_are_counted_once_for_all_families_of_long_numbers(spark):
    made = detectors.raw_hits(F.col("t"), F.col("t"), F.col("t"))
    plan = spark.createDataFrame([("a",)], "t string").select(made.alias("h"))._jdf.queryExecution().logical().toString()
    assert plan.count("(?:[^0-9]*+[0-9]){9}") == 1


def test_cheap_forms_say_the_same_as_plain_ones(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    t, low, fold = F.col("t"), F.lower("t"), T.fold_turkish(F.col("t"))
    plain = F.regexp_replace(F.regexp_replace(t, "[‐‑‒–—−]", "-"), "[＿﹍﹎]", "_")
    pairs = {
        "dash": (T.one_dash(t), F.regexp_replace(F.regexp_replace(plain, spelled(r"\s*_\s*"), "_"), spelled(r"\s*-\s*"), "-")),
        "trunk": (T.rewrite_trunk_o(t), F.regexp_replace(t, spelled(r"(^|[^A-Za-z0-9])[OoΟοОоØø](?=\s*[0-9])"), "$10")),
        "dashed": (detectors._dashed(t), t.rlike("[-_‐-―−＿﹍﹎]")),
        "nine": (t.rlike("^(?:[^0-9]*+[0-9]){9}"), F.length(F.regexp_replace(t, "[^0-9]", "")) >= 9),
        "wraps": (scan._may_wrap(t), t.rlike(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9 -]*$|(?i:bearer)")),
        "folded": (F.when(F.octet_length(t) == F.length(t), low).otherwise(fold), fold),
        "place": (F.concat(F.lit(" "), fold).rlike(spelled(r"[^a-z0-9](?:in|at)\s+(?:ankara|istanbul|izmir)")), fold.rlike(spelled(r"(?<![a-z0-9])(?:in|at)\s+(?:ankara|istanbul|izmir)"))),
    }
    got = rows.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in pairs.items()]).collect()
    assert not [(n, r.t, r[n]) for r in got for n in pairs if r[n].a != r[n].b]
