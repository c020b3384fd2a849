"""Quality rules with robust multivariate outliers, in DataFrame operations alone.

Base statistics come from whole texts; words are ``[^\\x20\\x09-\\x0D]+``. A repeated window is an 8-word window whose
64-bit hash occurs twice or more in the text; all positions that such windows cover count, the first included.

Documents that pass the base rules become vectors of four transformed statistics: log mean word length, the square root of
the share of symbols, and the shares of repeated lines and of words in repeated windows. For every language and source a
minimum-covariance-determinant estimate is sought as FAST-MCD does: several small random subsets start, concentration
steps keep the closest three quarters, the start with the least determinant goes on until its determinant falls no further. A
step is one aggregation: moments are summed by distance bin (partial sums before the shuffle, a fixed number of bins a group), and
a running sum over the bins finds the subset. The last bin counts with the share that completes three quarters exactly, so
determinants are compared over equal weights and the result doesn't depend on row order. Variances have a floor, as most
shares are zero in clean text: each floor is a fifth of the value at which a statistic alone rejects in a group where it never varies.

Groups with fewer than ``least_rows`` vectors use their language's estimate, or else the table's; those are fitted on all
vectors of the language or the table, and only where some group needs them.

Defined results: a null text counts as empty and fails the base rules; null languages and sources are groups of their own, and so
is the whole table where those columns are missing; very long texts count whole; repeated rows are each returned; a distance equal to
the cutoff is kept; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.runtime import Stages, bounded_broadcast

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
Z = ["z1", "z2", "z3", "z4"]
FLOORS = [0.10, 0.06, 0.06, 0.05]  # least standard deviations: 30 % repeated lines or 25 % repeated words are outliers by themselves
CUTOFF = 25.0  # squared distance; about the 0.99995 quantile of chi-squared with four degrees of freedom
SHARE = 0.75  # of a group's vectors in the concentrated subset
BINS = 8  # distance bins for each factor of e
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = lambda c, by: F.filter(F.split(c, by, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    # Each step is a projection of its own: arrays that later steps read several times are built once.
    one = docs.withColumns({
        "_hashes": F.transform(split(text, SPACE), lambda w: F.xxhash64(w)),
        "_lines": lines,
        "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    last = F.size("_hashes") - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    two = one.select("*", F.size("_hashes").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_windows")).drop("_hashes", "_lines")
    # Only texts with an equal pair of windows are sorted.
    ordered = F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    three = two.withColumn("_sorted", ordered).drop("_windows")
    beside = lambda k: F.get("_sorted", k)["h"]
    twice = F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == beside(k - 1), F.lit(False)) | F.coalesce(x["h"] == beside(k + 1), F.lit(False)))
    four = three.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_sorted")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_at", start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])
    five = four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")
    return five.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vectors() -> list[Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    length = F.log(F.greatest(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(0.5)))
    return [length.alias("z1"), F.sqrt(share("n_symbols", "word_chars")).alias("z2"), share("n_dup_lines", "n_lines").alias("z3"), share("n_repeat_words", "n_words").alias("z4")]


def consistency() -> float:
    """Factor that makes the covariance of the closest SHARE of normal vectors unbiased, for four dimensions."""
    lo, hi = 0.0, 100.0
    tail = lambda x, terms: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(terms))
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid, 2) < SHARE else (lo, mid)
    return SHARE / (1 - tail(lo, 3))


def estimates(moments: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means, Cholesky factors (lower, l_ij) and log determinant from sums; variances are raised by their floors."""
    mean = moments.select(*keys, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(4)], *[(F.col(f"q{i}{j}") / F.col("n")).alias(f"q{i}{j}") for i, j in PAIRS])
    cov = mean.select(*keys, *[f"m{i}" for i in range(4)], *[((F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        cov = cov.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return cov.withColumn("logdet", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(4)), F.lit(0.0))).drop(*[f"c{i}{j}" for i, j in PAIRS])


def with_distance(rows: DataFrame) -> DataFrame:
    """``rows`` (z and estimates side by side) with d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(4):
        rest = F.col(Z[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(4)), F.lit(0.0))).drop(*[f"y{i}" for i in range(4)])


def sums() -> list[Column]:
    z = [F.col(c) for c in Z]
    return [F.count("*").alias("n"), *[F.sum(z[i]).alias(f"s{i}") for i in range(4)], *[F.sum(z[i] * z[j]).alias(f"q{i}{j}") for i, j in PAIRS]]


def concentrate(points: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """One concentration step of every (grp, start) in ``params``."""
    held = params.select("grp", "start", *[f"m{i}" for i in range(4)], *[f"l{i}{j}" for i, j in PAIRS])
    near = with_distance(points.join(bounded_broadcast(held, groups), "grp"))
    bins = near.groupBy("grp", "start", F.floor(F.log(F.col("d2") + 1e-9) * BINS).alias("bin")).agg(*sums())
    run = Window.partitionBy("grp", "start").orderBy("bin")
    whole = Window.partitionBy("grp", "start")
    need = F.ceil(SHARE * F.sum("n").over(whole)) - (F.sum("n").over(run) - F.col("n"))
    kept = bins.withColumn("share", F.least(F.lit(1.0), need / F.col("n"))).where("share > 0")
    total = kept.groupBy("grp", "start").agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in ["n", *[f"s{i}" for i in range(4)], *[f"q{i}{j}" for i, j in PAIRS]]])
    return estimates(total, ["grp", "start"], consistency())


def group_names(points: DataFrame, stages: Stages, least_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(``points`` with ``grp``, the estimate that judges each; the vectors that each estimate is fitted on; the number of estimates).

    Estimates are of a language and source, of a language, or of everything, whichever is the first with enough rows.
    """
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source"))
    keyed = points.withColumns({"_l": lang, "_s": source})
    counts = keyed.groupBy("_l", "_s").count()
    by_lang = counts.groupBy("_l").agg(F.sum("count").alias("of_lang"))
    own, language = F.concat(F.lit("s"), F.to_json(F.array("_l", "_s"))), F.concat(F.lit("l"), F.to_json(F.array("_l")))
    grp = F.when(F.col("count") >= least_rows, own).when(F.col("of_lang") >= least_rows, language).otherwise("*")
    names = stages.write(counts.join(by_lang, "_l").select("_l", "_s", grp.alias("grp")), "groups")
    used = stages.write(names.select("grp").distinct(), "used")
    # A group's rows feed its own estimate, its language's and the table's, as far as those judge anything.
    feeds = stages.write(names.select("_l", "_s", F.explode(F.array(own, language, F.lit("*"))).alias("grp")).join(used, "grp", "left_semi"), "feeds")
    sizes = names.count()
    judged = keyed.join(bounded_broadcast(names, sizes), ["_l", "_s"]).drop("_l", "_s")
    fitted = keyed.join(bounded_broadcast(feeds, 3 * sizes), ["_l", "_s"]).select("doc_id", "grp", *Z)
    return judged, fitted, used.count()


def robust_estimates(points: DataFrame, groups: int, stages: Stages, starts: int = 6, first_steps: int = 2, most_steps: int = 50) -> DataFrame:
    """One row of estimates for each grp of ``points`` (doc_id, grp, z1..z4). Raises where a determinant still falls after ``most_steps``."""
    sizes = stages.write(points.groupBy("grp").agg(F.count("*").alias("rows")), "sizes")
    sized = points.join(bounded_broadcast(sizes, groups), "grp")
    # Start 0 is the whole group; the others are about a dozen of its rows, drawn by a hash of the vector and id.
    draw = lambda s: F.pmod(F.xxhash64("doc_id", *Z, s), F.greatest(F.col("rows") / 12, F.lit(1)).cast("long")) == 0
    chosen = sized.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts)))).where((F.col("start") == 0) | draw(F.col("start")))
    params = stages.write(estimates(chosen.groupBy("grp", "start").agg(*sums()), ["grp", "start"], 1.0), "starts")
    for k in range(first_steps):
        params = stages.write(concentrate(points, params, groups * (starts + 1)), f"first{k}")
    best = params.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("best")).select("grp", F.col("best.start").alias("start"))
    params = params.join(best, ["grp", "start"])
    for k in range(most_steps):
        # Bins are coarse, so a determinant may rise by a little: a group keeps the better estimate, and rests once none falls.
        new = concentrate(points, params, groups).join(params.select("grp", F.col("logdet").alias("had")), "grp")
        step = stages.write(new.withColumn("fell", F.col("logdet") < F.col("had") - 1e-3), f"last{k}")
        fallen = step.where("fell").drop("had", "fell")
        params = fallen.unionByName(params.join(fallen.select("grp"), "grp", "left_anti"))
        if not step.where("fell").take(1):
            break
        params = stages.write(params, f"held{k}")
    else:
        raise RuntimeError(f"estimates did not settle within {most_steps} steps")
    return params.drop("start", "logdet")


def judge(docs: DataFrame, least_rows: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (null where the base rules fail) and kept."""
    stages = Stages(docs.sparkSession, "robust-quality")
    had = {c.lower() for c in docs.columns}
    group = [F.col(c).alias(c) if c in had else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *group)
    stats = stages.write(base_statistics(rows).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed"), "statistics")
    points, feeding, groups = group_names(stats.where("not base_failed").select("*", *vectors()), stages, least_rows)
    fitted = robust_estimates(feeding, groups, stages)
    passed = with_distance(points.join(bounded_broadcast(fitted, groups), "grp"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = passed.select(*columns, F.col("d2").alias("distance"), (F.col("d2") <= CUTOFF).alias("kept"))
    failed = stats.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return passed.union(failed)
