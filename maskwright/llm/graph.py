"""Connected components as alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.runtime import Stages


def connected_components(edges: DataFrame, stages: Stages, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst: long); root is the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): each is one algebraic minimum per node and one
    equi-join, so a hub never gathers its neighbours in one place. Every round is a written table. An empty
    edge table gives an empty result; self-loops and repeated edges change nothing.
    """
    now = stages.write(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if before == (found.n, found.h) or not found.n:
            break
        before = (found.n, found.h)
        both = now.union(now.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        large = stages.write(large, "large")
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = down.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").union(low.select("src", F.col("low").alias("dst"))).distinct()
        small = stages.write(small, "small")
        stages.drop(now, large)
        now = small
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
