"""Embedding near-duplicates by an inverted multi-index: cosine links of 0.95 and above, and their components.

Vectors are brought to unit length and cut in halves; a codebook for each half spans a product grid of cells, and every
vector lies in the cell of its two nearest centroids. A vector's traversal visits cells by the sum of its two centroid
distances (the multi-sequence order of Babenko and Lempitsky, 2012) until a target recall, and every vector met there is
verified by cosine in double precision. Each pair is looked for once, from its smaller class number.

The number of cells visited is measured: a bounded query set is compared with all rows by brute force, in blocks, and the
ranks of the true neighbours' cells give the shortest traversal whose recall, over queries and over pairs, reaches ``recall``.
Where few queries have a neighbour, copies of them turned away to the threshold are looked for as well. The recall is returned with the rows.
Codebooks are fitted on a bounded sample (64 rows a centroid, 4096 centroids a half and 128 MB at most); every row is indexed.

Exact copies are one class and are searched once. Cells with many members or visitors are dealt out in blocks of about
``block`` rows, and each block pair returns one count and one local root a row, so no group is gathered whole and no
list of pairs is ever made.

Vectors link only with vectors of their length. Each length with more vectors than a block has an index of its own; the vectors of all
rarer lengths are compared exactly, as if each such length were one cell.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing (n_links 0, its
own component). Null ids are counted but never name a component. Repeated rows link with each other; a cosine equal to the
threshold links; ties between cells are broken by their numbers; floats, doubles and integers are compared as doubles; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.graph import connected_components
from maskwright.llm.runtime import Stages, hash_sample, heavy_keys, join_spread

MOST_CENTROIDS = 4096
SAMPLE_BYTES = 128 << 20
BLOCK = 384  # rows of a block; lengths with no more vectors are one block, and have no index


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    rows = rows / np.maximum(np.abs(rows).max(1, keepdims=True), 1e-300)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 10) -> np.ndarray:
    """Centroids of ``rows`` by Lloyd's rounds from distinct random rows; empty cells keep their centroid."""
    centres = rows[np.sort(np.random.default_rng(seed).permutation(len(rows))[:k])].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(rows[a : a + 4096], centres).argmin(1) for a in range(0, len(rows), 4096)])
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1), 0)


def multi_sequence(first: np.ndarray, second: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The ``visits`` nearest cells of one vector, from its distances to each half's centroids, by the heap of the paper."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]

    def cells(self, rows: np.ndarray, visits: int) -> np.ndarray:
        """len(rows) x visits cell numbers in multi-sequence order; the first is the row's own cell.

        The heap can only ever pop ranks (a, b) with (a + 1)(b + 1) <= visits, so those sums are sorted for a whole
        batch at once.
        """
        visits = min(visits, len(self.first) * len(self.second))
        d1, d2 = _distances(rows[:, : self.half], self.first), _distances(rows[:, self.half :], self.second)
        near1, near2 = (np.argsort(d, 1, kind="stable")[:, :visits] for d in (d1, d2))
        d1, d2 = np.take_along_axis(d1, near1, 1), np.take_along_axis(d2, near2, 1)
        a, b = np.indices((near1.shape[1], near2.shape[1])).reshape(2, -1)
        within = (a + 1) * (b + 1) <= visits
        a, b = a[within], b[within]
        best = np.argsort(d1[:, a] + d2[:, b], 1, kind="stable")[:, :visits]
        return np.take_along_axis(near1, a[best], 1).astype(np.int64) * len(self.second) + np.take_along_axis(near2, b[best], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def classes(vectors: DataFrame, stages: Stages, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with vec_id, a vector or null, and its hash; one row for each distinct usable vector, with its length)."""
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("v", F.when(good, F.col("v")))
    # Unusable vectors match nothing; a hash of their own keeps them from meeting in one task.
    rows = rows.withColumn("h", F.when(F.col("v").isNull(), F.xxhash64("vec_id", F.rand(10))).otherwise(F.xxhash64("v")))
    groups = rows.where("v is not null").groupBy("h", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    return rows, stages.write(groups.select("*", F.monotonically_increasing_id().alias("cid"), F.size("v").alias("dim")), "classes")


def fit_grid(groups: DataFrame, n: int, dim: int, cell_rows: int = 64) -> Grid:
    k = int(max(1, min(MOST_CENTROIDS, round((n / cell_rows) ** 0.5))))
    rows = max(k, min(64 * k, SAMPLE_BYTES // (8 * dim)))
    sample = hash_sample(groups, n, rows, 10, "cid").orderBy(F.xxhash64("cid", F.lit(10)), "cid").limit(rows).select("v").toArrow()["v"].combine_chunks()
    rows = unit(_matrix(sample))
    half = max(1, dim // 2)
    return Grid(k_means(rows[:, :half], k), k_means(rows[:, half:], k) if dim > 1 else np.zeros((1, 0)))


def measure_visits(groups: DataFrame, n: int, grid: Grid, least: float, recall: float, queries: int = 512, longest: int = 256, wanted: int = 200, floor: float = 0.9, most: int = 8192) -> tuple[int, float, float]:
    """(cells to visit, recall by query, recall by pair): query sets in hash order against all rows; only counts are gathered.

    Recall by query is the mean over queries with neighbours, so a query in a dense group weighs no more than another; recall by pair
    weighs dense groups most. The traversal reaches ``recall`` in both. The query set grows to ``most`` until ``wanted`` of
    them have neighbours. With fewer, copies of the queries turned to a cosine of just ``least`` are looked for too, and count
    alone where no query has a neighbour. The traversal is lengthened, to the whole grid if need be, while recall is below ``floor``.
    """
    whole = len(grid.first) * len(grid.second)
    while True:
        asked = hash_sample(groups, n, queries, 11, "cid").orderBy(F.xxhash64("cid", F.lit(11)), "cid").limit(queries).select("cid", "v").toArrow()
        base = unit(_matrix(asked["v"].combine_chunks()))
        by_query, by_pair, met = _reached(groups, grid, least, np.asarray(asked["cid"]), base, min(longest, whole))
        if met < wanted and queries < min(n, most):
            queries = min(4 * queries, most)
            continue
        if met < wanted:
            turned = _turned_recall(grid, base[:512], least, min(longest, whole))
            by_query, by_pair = (np.minimum(c, turned) if met else turned for c in (by_query, by_pair))
        lower = np.minimum(by_query, by_pair)
        if lower[-1] < min(floor, recall) and longest < whole:
            longest = min(4 * longest, whole)
        else:
            break
    enough = np.flatnonzero(lower >= recall - 1e-12)
    visits = int(enough[0]) + 1 if len(enough) else len(lower)
    return visits, float(by_query[visits - 1]), float(by_pair[visits - 1])


def _turned_recall(grid: Grid, base: np.ndarray, least: float, longest: int) -> np.ndarray:
    """By number of cells visited, how many rows a copy turned to a cosine of ``least`` finds: the farthest neighbours there can be."""
    away = np.random.default_rng(12).normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    length = np.sqrt((away * away).sum(1, keepdims=True))
    away = np.where(length > 1e-9, away / np.maximum(length, 1e-9), 0.0)
    hit = grid.cells(unit(least * base + (1 - least * least) ** 0.5 * away), longest) == grid.cells(base, 1)
    return np.cumsum(hit.mean(0))


def _reached(groups: DataFrame, grid: Grid, least: float, ids: np.ndarray, base: np.ndarray, longest: int, block: int = 512) -> tuple[np.ndarray, np.ndarray, int]:
    """By number of cells visited: (mean recall of the queries with neighbours, recall over their pairs), and how many such queries there are."""

    def ranks(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                rows, own = unit(_matrix(part.column(1))), np.asarray(part.column(0))
                homes = grid.cells(rows, 1)
                for at in range(0, len(ids), block):
                    q, r = np.nonzero((base[at : at + block] @ rows.T >= least) & (ids[at : at + block, None] != own[None, :]))
                    if len(q):
                        asking, place = np.unique(q, return_inverse=True)
                        hit = grid.cells(base[at + asking], longest)[place] == homes[r]
                        found = np.where(hit.any(1), hit.argmax(1), longest)
                        pairs, counts = np.unique((at + q) * (longest + 1) + found, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs // (longest + 1)), pa.array(pairs % (longest + 1)), pa.array(counts)], names=["query", "rank", "n"])

    counts = groups.select("cid", "v").mapInArrow(ranks, "query long, rank long, n long").groupBy("query", "rank").agg(F.sum("n").alias("n"))
    shares = counts.join(counts.groupBy("query").agg(F.sum("n").alias("of")), "query")
    found = shares.groupBy("rank").agg(F.sum(F.col("n") / F.col("of")).alias("share"), F.sum("n").alias("n")).collect()
    at_rank, pairs = np.zeros(longest + 1), np.zeros(longest + 1)
    for r in found:
        at_rank[r["rank"]], pairs[r["rank"]] = r.share, r.n
    met = round(at_rank.sum())
    return np.cumsum(at_rank)[:-1] / max(met, 1), np.cumsum(pairs)[:-1] / max(pairs.sum(), 1), met


def _local_roots(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id in each row's and column's component of a bipartite link matrix without empty rows or columns."""
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(links, right[None, :], top).min(1))
        new_right = np.minimum(right, np.where(links, new_left[:, None], top).min(0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def place(groups: DataFrame, grid: Grid, visits: int) -> DataFrame:
    """cid, copies, v and the cells to visit, a row's own cell first."""

    def over(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cells = grid.cells(unit(_matrix(part.column(2))), visits)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cells), pa.list_(pa.int64()))], names=["cid", "copies", "v", "cells"])

    return groups.select("cid", "copies", "v").mapInArrow(over, "cid long, copies long, v array<double>, cells array<long>")


def class_links(placed: DataFrame, least: float, stages: Stages, block: int = 384) -> DataFrame:
    """(cid, n, root): for each class and block pair with links, the vectors linked there and a local root. Cells hold one length."""
    placed = stages.write(placed, "placed")
    homes = placed.select("cid", "copies", "v", F.col("cells")[0].alias("cell"))
    calls = placed.select("cid", "copies", "v", F.explode("cells").alias("cell"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = homes.groupBy("cell").agg(F.count("*").alias("m")).join(calls.groupBy("cell").agg(F.count("*").alias("c")), "cell")
    sizes = stages.write(sizes.select("cell", blocks(F.col("m")).alias("mb"), blocks(F.col("c")).alias("cb")), "cells")
    spread = lambda rows, own, other, names: rows.join(sizes, "cell").select("cid", "copies", "v", "cell", F.pmod(F.xxhash64("cid"), F.col(own)).alias(names[0]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other).cast("long") - 1)).alias(names[1]))
    members = spread(homes, "mb", "cb", ("i", "j"))
    visitors = spread(calls, "cb", "mb", ("j", "i"))

    def verify(both: pa.Table) -> pa.Table:
        out, side = [np.zeros(0, np.int64)] * 3, both["caller"]
        member, caller = both.filter(pc.invert(side)), both.filter(side)
        if member.num_rows and caller.num_rows:
            m_id, c_id = (np.asarray(t["cid"].combine_chunks()) for t in (member, caller))
            m, c = (unit(_matrix(t["v"].combine_chunks())) for t in (member, caller))
            links = (c @ m.T >= least) & (c_id[:, None] < m_id[None, :])
            on_c, on_m = links.any(1), links.any(0)
            if on_c.any():
                links = links[on_c][:, on_m]
                m_n, c_n = np.asarray(member["copies"].combine_chunks())[on_m], np.asarray(caller["copies"].combine_chunks())[on_c]
                left, right = _local_roots(links, c_id[on_c], m_id[on_m])
                out = [np.concatenate(p) for p in ((c_id[on_c], m_id[on_m]), (links @ m_n, c_n @ links), (left, right))]
        return pa.table([pa.array(o.astype(np.int64)) for o in out], names=["cid", "n", "root"])

    key = ["cell", "i", "j"]
    both = members.withColumn("caller", F.lit(False)).unionByName(visitors.withColumn("caller", F.lit(True)))
    return stages.write(both.groupBy(*key).applyInArrow(verify, "cid long, n long, root long"), "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, recall: float = 0.995, block: int = BLOCK, exact: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``, index_recall and index_pair_recall.

    The last two: the recall, by query and by pair, that was measured for the index over vectors of a row's length; 1 for lengths of
    ``exact`` vectors at most, which are compared exactly. Neither is below 0.9: the traversal is lengthened to the whole grid if need be.
    """
    stages = Stages(vectors.sparkSession, "multi-index")
    rows, groups = classes(vectors, stages, id_col, vector_col)
    # Lengths with an index have over ``exact`` vectors each, so they are few; only their names and sizes are gathered.
    large = {r["dim"]: r["n"] for r in groups.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > exact).collect()}
    measured, found = {}, []
    for dim, n in sorted(large.items()):
        own = groups.where(F.col("dim") == dim)
        grid = fit_grid(own, n, dim)
        visits, *measured[dim] = measure_visits(own, n, grid, least, recall)
        if min(measured[dim]) < min(0.9, recall):
            raise RuntimeError(f"recall {measured[dim]} over vectors of length {dim}")
        found.append(class_links(place(own, grid, visits), least, stages, block))
    if len(large) < groups.select("dim").distinct().count():
        few = groups.where(~F.col("dim").isin(list(large))) if large else groups
        found.append(class_links(few.select("cid", "copies", "v", F.array(F.col("dim").cast("long")).alias("cells")), least, stages, block))
    if found:
        links = functools.reduce(DataFrame.unionByName, found)
        roots = connected_components(links.select(F.col("cid").alias("src"), F.col("root").alias("dst")), stages)
        totals = links.groupBy("cid").agg(F.sum("n").alias("n"))
        known = groups.join(totals, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        known = stages.write(known.select("h", "v", "least", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "known")
        whole = stages.write(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "whole")
        named = join_spread(known.drop("least"), whole.drop("classes"), "root", heavy_keys(whole, "root", "classes")).drop("root")
    else:
        named = groups.select("h", "v", "copies", F.col("copies").alias("n_links"), F.col("least").alias("component_id"))
    # Vectors with very many copies meet a broadcast of their few rows; the others are shuffled by hash.
    heavy = heavy_keys(groups, "h", "copies")
    named = named.drop("copies").withColumnRenamed("v", "w")
    met = lambda a, b: a.join(b, (a["h"] == b["h"]) & (a["v"] == b["w"]), "left").drop(b["h"]).drop("w")
    if heavy:
        hot = F.col("h").isin(heavy)
        found = met(rows.where(hot), F.broadcast(named.where(hot))).unionByName(met(rows.where(~hot), named.where(~hot)))
    else:
        found = met(rows, named)
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    by_query = by_pair = F.lit(1.0)
    for dim, (of_queries, of_pairs) in measured.items():
        by_query = F.when(F.size("v") == dim, F.lit(of_queries)).otherwise(by_query)
        by_pair = F.when(F.size("v") == dim, F.lit(of_pairs)).otherwise(by_pair)
    return found.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), by_query.alias("index_recall"), by_pair.alias("index_pair_recall")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
