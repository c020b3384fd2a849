"""SimHash near-duplicates: 64-bit fingerprints, linked within a small Hamming distance.

Fingerprint: texts are lower-cased over A-Z, split into words ``[^\\x20\\x09-\\x0D]+`` and hashed as word shingles
(XXH64, seed 42); a bit is set where more than half of the shingle hashes, repeats included, set it.

Search: the generalised pigeonhole principle. The 64 bits are grouped into m parts, correlated bits together, and the
distance budget is shared out as thresholds t_1..t_m with sum tau - m + 1 (-1: the part is not probed). Any two
fingerprints within tau then agree within t_i on some part i. A dynamic programme picks the thresholds, and a loop the
number of parts, by estimated cost; the estimates steer only cost, the result is exact for every choice. Probing is one
equi-join on the masked part (and its one- or two-bit neighbours where t_i is above 0); the join's residual condition verifies
the whole distance. Buckets over ``hot`` members are split by the same principle over the remaining bits, so that no
link is lost and no bucket is paired in full.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; very long texts are hashed whole,
65,536 shingles at a time; a bit set in exactly half of the hashes is 0; repeated rows are each returned; an empty table gives an empty result; extra columns are kept, those named like an output column are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.graph import connected_components
from maskwright.llm.runtime import Stages, add_columns, hash_sample, heavy_keys, join_spread, without

BITS = 64
BLOCK = 1 << 16  # shingles counted at a time, which bounds memory for very long texts


def shingle_hashes(raw: bytes, width: int = 3):
    """Arrays of the XXH64 hashes of a UTF-8 text's word shingles, repeats included, ``BLOCK`` at a time; none for a blank text."""
    flat = np.frombuffer(raw.lower(), np.uint8)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    solid = ~blank
    if not solid.any():
        return
    # One space before every word, none elsewhere: shingles become slices of a single byte string.
    first = solid.copy()
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    keep = solid.copy()
    keep[starts[starts > 0] - 1] = True
    at = np.cumsum(keep) - 1
    last = solid.copy()
    last[:-1] &= blank[1:]
    ends = (at[np.flatnonzero(last)] + 1).tolist()
    begins = at[starts].tolist()
    text = np.where(blank, np.uint8(32), flat)[keep].tobytes()
    k = min(width, len(begins))
    n = len(begins) - k + 1
    hashed = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        yield np.array([hashed(text[a:b], 42) for a, b in zip(begins[lo:hi], ends[lo + k - 1 : hi + k - 1])], "<u8")


def fingerprint(raw: bytes, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    ones, n = np.zeros(BITS, np.int64), 0
    for found in shingle_hashes(raw, width):
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(found)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def add_fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with column ``fp`` (long: the fingerprint's 64 bits)."""

    def compute(texts: pa.Array) -> list:
        raw = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()
        return [np.array([fingerprint(x, width) for x in raw], np.uint64).view(np.int64)]

    return add_columns(docs, text_col, [T.StructField("fp", T.LongType())], compute)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and 64 x 64 co-occurrence counts over all of ``fps``; at most 4096 sums reach the driver."""

    def partial(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(np.asarray(b.column(0)).astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.indices((BITS, BITS))
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel().astype(np.int64)), pa.array(np.full(BITS * BITS, n))], names=["i", "j", "ones", "n"])

    rows = fps.select("fp").mapInArrow(partial, "i long, j long, ones long, n long").groupBy("i", "j").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect()
    out, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        out[r.i, r.j], n = r.ones, r.n
    return n, out


def group_bits(n: int, moments: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal width, each grown greedily by absolute correlation."""
    mean = np.diag(moments) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tied = np.abs((moments / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, groups = set(range(BITS)), []
    for p in range(parts):
        width = len(free) // (parts - p)
        seed = max(free, key=lambda b: (tied[b, sorted(free)].sum(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < width:
            best = max(free, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least total cost; costs[i][t] is part i's cost at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for (spent, (cost, chosen)), (t, extra) in itertools.product(best.items(), part.items()):
            if spent + t not in step or cost + extra < step[spent + t][0]:
                step[spent + t] = (cost + extra, [*chosen, t])
        best = step
    return best[budget]


def plan_parts(fps: DataFrame, tau: int, sample: int = 4096, choices: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part. Candidate counts are estimated from at most ``sample`` fingerprints, in hash order."""
    n, moments = bit_moments(fps)
    rows = hash_sample(fps.select("fp"), n, sample, 2, "fp").orderBy(F.xxhash64("fp", F.lit(2)), "fp").limit(sample).collect()
    seen = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    all_pairs = max(1, len(seen) * (len(seen) - 1) // 2)
    scale = n * (n - 1) / 2 / all_pairs
    options = []
    for parts in choices:
        groups, costs = group_bits(n, moments, parts), []
        for bits in groups:
            own = seen & np.uint64(sum(1 << b for b in bits))
            apart = np.zeros(BITS + 1, np.int64)
            for k in range(len(own) - 1):
                apart += np.bincount(np.bitwise_count(own[k] ^ own[k + 1 :]), minlength=BITS + 1)
            w = len(bits)
            ball = {0: 1, 1: 1 + w, 2: 1 + w + w * (w - 1) // 2}
            cost = {-1: 0.0}
            for t in range(min(tau, 2) + 1):
                # Half a pair is added: the sample can't show rates below one pair in all of its own.
                cost[t] = n * (1 + ball[t]) + (int(apart[: t + 1].sum()) + 0.5) * scale
            costs.append(cost)
        if -parts <= tau - parts + 1 <= 2 * parts:
            cost, chosen = allocate(costs, tau - parts + 1)
            options.append((cost, parts, [(b, t) for b, t in zip(groups, chosen) if t >= 0]))
    return min(options)[2]


def _ball(value, bits: list[int], t: int):
    flips = [0]
    if t >= 1:
        flips += [1 << b for b in bits]
    if t >= 2:
        flips += [(1 << a) | (1 << b) for a, b in itertools.combinations(bits, 2)]
    return F.array(*[value.bitwiseXOR(F.lit(_signed(f))) for f in flips])


def _labelled(keys, part: int):
    return F.transform(keys, lambda key: F.struct(F.lit(part).alias("part"), key.alias("key")))


def linked_pairs(fps: DataFrame, stages: Stages, tau: int = 2, hot: int = 256) -> DataFrame:
    """Pairs (src < dst) of distinct fingerprints at Hamming distance 1..tau. ``fps``: one row per fingerprint."""
    if not 0 <= tau <= 8:
        raise ValueError("probing enumerates at most two flipped bits of a part, which serves distances up to eight")
    parts = plan_parts(fps, tau)
    fp = F.col("fp")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= tau
    homes, probes, finer = [], [], []
    for p, (bits, t) in enumerate(parts):
        held = fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        homes.append(F.array(F.struct(F.lit(p).alias("part"), held.alias("key"))))
        probes.append(_labelled(_ball(held, bits, t), p))
        rest = [b for b in range(BITS) if b not in bits]
        finer.append(F.array(*[fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in rest[s :: tau + 1])))) for s in range(tau + 1)]))
    # Within a hot bucket the rest of the bits differ in tau places at most, so one of tau + 1 slices agrees.
    slices = F.element_at(F.array(*finer), F.col("part") + 1)
    home = fps.select("fp", F.inline(F.flatten(F.array(*homes))))
    probe = fps.select("fp", F.inline(F.flatten(F.array(*probes))))
    full = home.groupBy("part", "key").count().where(F.col("count") > hot).select("part", "key", F.lit(True).alias("full"))
    full = stages.write(full, "hot")
    any_hot = bool(full.take(1))
    if any_hot:
        mark = lambda d: d.join(full, ["part", "key"], "left").select("fp", "part", "key", F.posexplode(F.when(F.col("full"), slices).otherwise(F.array(F.lit(0).cast("long")))).alias("slice", "sub"))
        home, probe, on = mark(home), mark(probe), ["part", "key", "slice", "sub"]
    else:
        on = ["part", "key"]
    left, right = home.withColumnRenamed("fp", "src").alias("h"), probe.withColumnRenamed("fp", "dst").alias("p")
    match = [F.col(f"h.{c}") == F.col(f"p.{c}") for c in on] + [F.col("src") < F.col("dst"), near("src", "dst")]
    return left.join(right, match).select("src", "dst").distinct()


def near_duplicates(keyed: DataFrame, tau: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``keyed`` (any columns, with ``fp``) plus ``component_id``: the smallest id linked to the row by a chain.

    Ids that are null are ignored by the minimum; a component without any id has a null component_id. Exact copies
    share a fingerprint, which is searched once however many rows carry it.
    """
    spark = keyed.sparkSession
    stages = Stages(spark, "simhash")
    keyed = stages.write(without(keyed, "component_id", "root"), "rows")
    fps = stages.write(keyed.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")), "fps")
    roots = connected_components(linked_pairs(fps, stages, tau), stages)
    named = stages.write(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    whole = stages.write(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "whole")
    named = join_spread(named.select("fp", "root"), whole.drop("members"), "root", heavy_keys(whole, "root", "members"))
    return join_spread(keyed, named, "fp", heavy_keys(fps, "fp", "copies"))


def hexed(fp):
    """Sixteen lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, tau: int = 2, width: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each near-duplicate group, with all of its columns: the smallest id (rows without an id come last)."""
    spark = docs.sparkSession
    stages, columns = Stages(spark, "simhash-keep"), docs.columns
    rows = stages.write(add_fingerprints(docs, text_col, width).withColumn("rid", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select("fp", "rid", F.col(id_col).alias("doc_id")), tau)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("best"))
    return rows.join(best.select(F.col("best.rid").alias("rid")), "rid", "left_semi").select(*columns)
