import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import queries, robust_quality as R
from maskwright.llm.runtime import Stages


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base)


def columns(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_statistics_match_brute_force(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    loops = spark.createDataFrame([(-1, "a b c d e f g h " * 7 + "x"), (-2, "a " * 30), (-3, ("w%d " * 9 % tuple(range(9))) + "y " + ("w%d " * 9 % tuple(range(9))))], docs.schema)
    every = docs.union(loops).union(odd_docs.select("doc_id", "text"))
    for r in R.base_statistics(every).collect():
        assert columns(r) == slow_statistics(r.text)
    assert R.base_statistics(no_docs).count() == 0


def exact_mcd(z, draws=200, seed=0):
    """Squared distances under FAST-MCD with exact subsets: the closest three quarters by rank, from many random starts."""
    rng, need, floor = np.random.default_rng(seed), math.ceil(R.SHARE * len(z)), np.diag(np.array(R.FLOORS) ** 2)

    def measured(pick, scale):
        mean, cov = z[pick].mean(0), np.cov(z[pick].T, bias=True) * scale + floor
        return np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean), np.linalg.slogdet(cov)[1]

    best = (np.inf, None)
    for _ in range(draws):
        d2, _ = measured(rng.permutation(len(z))[:12], 1.0)
        for _ in range(30):
            d2, det = measured(np.argsort(d2, kind="stable")[:need], R.consistency())
        best = min(best, (det, d2.tolist()))
    return np.array(best[1])


def frame(spark, z, lang="en", source="web", first=0):
    return spark.createDataFrame([(first + i, lang, source, *map(float, v)) for i, v in enumerate(z)], "doc_id long, lang string, source string, z1 double, z2 double, z3 double, z4 double")


def test_verdicts_match_exact_concentration(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(0, 0.3, (400, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.2], [0, 0, 0, 1]])
    z[:80] += 4
    stages = Stages(spark, "t")
    df = frame(spark, z).withColumn("grp", F.lit("g"))
    robust = R.robust_estimates(df.select("doc_id", "grp", *R.Z), 1, stages)
    d2 = np.array([r.d2 for r in R.with_distance(df.join(robust, "grp")).orderBy("doc_id").collect()])
    want = exact_mcd(z)
    assert ((d2 <= R.CUTOFF) == (want <= R.CUTOFF)).all() and (d2[:80] > R.CUTOFF).all() and (d2[80:] <= R.CUTOFF).mean() > 0.98
    assert np.abs(np.log(d2 / want)).max() < 0.35


def test_small_groups_are_judged_by_their_language_or_the_table(spark):
    rng = np.random.default_rng(3)
    stages = Stages(spark, "t")
    usual, junk = rng.normal(0, 0.05, (300, 4)), np.array([[3.0, 2.0, 1.0, 1.0]])
    df = frame(spark, usual).union(frame(spark, junk, source="rare", first=1000)).union(frame(spark, usual[:1], source="rare", first=1001)).union(frame(spark, junk, lang=None, source=None, first=1002)).union(frame(spark, usual[:2], lang="xx", source=None, first=1003))
    judged, feeding, groups = R.group_names(df, stages, 50)
    fitted = R.robust_estimates(feeding, groups, stages)
    kept = {r.doc_id: r.d2 <= R.CUTOFF for r in R.with_distance(judged.join(fitted, "grp")).collect()}
    assert len(kept) == 305 and [kept[i] for i in range(1000, 1005)] == [False, True, False, True, True]
    assert groups == 3 and feeding.count() == 300 + 302 + 305


@pytest.mark.parametrize("change", [{"z1": 0.8}, {"z2": 0.4}, {"z3": 0.6}, {"z4": 0.29}])
def test_each_statistic_rejects_alone(spark, change):
    rng = np.random.default_rng(4)
    z = np.column_stack([rng.normal(1.6, 0.02, 200), np.zeros(200), np.zeros(200), np.zeros(200)])
    odd = np.array([[1.6 + change.get("z1", 0), change.get("z2", 0), change.get("z3", 0), change.get("z4", 0)]])
    stages = Stages(spark, "t")
    judged, feeding, groups = R.group_names(frame(spark, z).union(frame(spark, odd, first=900)), stages, 50)
    d2 = {r.doc_id: r.d2 for r in R.with_distance(judged.join(R.robust_estimates(feeding, groups, stages), "grp")).collect()}
    assert d2[900] > R.CUTOFF and sum(v > R.CUTOFF for v in d2.values()) == 1


def test_consistency_factor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400_000, 4))
    d2 = (x * x).sum(1)
    near = x[d2 <= np.quantile(d2, R.SHARE)]
    assert abs(R.consistency() * near.var() - 1) < 0.01


def test_query(spark, odd_docs, no_docs):
    at = "/root/testdata/sf0.01"
    rows = queries.op5_quality_rules(spark, at).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(columns(r) == slow_statistics(docs[r.doc_id]) and not (r.kept and r.base_failed) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    good = [r.kept for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if label.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.15
    repeated = spark.createDataFrame([(9, "one two three four five six seven eight nine ten\n" * 2 + "".join(f"w{k} x{k} y{k}\n" * 3 for k in range(12)), "en", "web")], "doc_id long, text string, lang string, source string")
    normal = spark.read.parquet(f"{at}/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang", "source")
    assert [r.kept for r in R.judge(normal.union(repeated.withColumn("doc_id", F.lit(-9)))).where("doc_id = -9").collect()] == [False]
    assert R.judge(odd_docs.select("doc_id", "text")).count() == odd_docs.count()
    assert R.judge(odd_docs.withColumns({"lang": F.when(F.col("doc_id") > 5, F.col("lang")), "source": F.lit(None).cast("string"), "kept": F.lit(1), "grp": F.lit("x"), "z1": F.lit(0)})).count() == odd_docs.count()
    odd = R.judge(odd_docs)
    assert odd.count() == odd_docs.count() and R.judge(no_docs).count() == 0
    plan = R.judge(spark.read.parquet(f"{at}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
