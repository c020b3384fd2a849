"""Prefix trie of conversations: shared beginnings as nodes, with sums over subtrees.

Every turn is digested (SHA-256 of role and text) before anything moves. A conversation's digests are chained, so that the
digest of its first d turns names the node at depth d; every prefix is laid out and grouped by (depth, digest). Each node is then
laid out to its ancestors, whose digests its row carries, and the sums over subtrees are one partial aggregation.

Long conversations: turns are numbered by one range partitioning over (conversation, turn), never by gathering a conversation.
Chains run in blocks of ``BLOCK`` turns: a block is chained by itself, the blocks' last digests are chained to one another (one row
of them for each conversation over one block), and a prefix's digest joins both. Ancestors are laid out in bands of ``LEVELS`` depths:
a node goes to those of its own band; the sums of the bands' top nodes are passed up by pointer doubling over the tops
alone; and each top goes to the band above it. So rows grow with nodes x ``LEVELS``, not with the square of a length.

A node with very many children or members is met by partial sums and by a broadcast of the few such nodes. The list of conversations
that end at a node is joined to strings by ranges of ids; one task then digests a node's strings in order, one at a time.

Defined results: null roles and texts are empty; turns come in order of ``turn``, null first, and equal ones in order of their
digests; repeated rows are turns of their own; turns without a conversation id belong to no conversation and are left out; an empty
table has no conversation and so no node, not even a root; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.runtime import Stages, heavy_keys, join_spread

BLOCK = 256
LEVELS = 32
CHUNK = 4096  # ids in one string
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _sha(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def _root() -> Column:
    return F.lit(hashlib.sha256(b"root").digest())


def number_turns(conversations: DataFrame, stages: Stages, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns in order with their part and place there, runs: one row for each conversation and part).

    turns: conv_id, part, at, leaf, n_bytes. runs: conv_id, part, first (its least place), before (the conversation's turns in
    earlier parts) and n_turns (of the whole conversation).
    """
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    leaf = _sha(F.concat(_sha(whole(role_col).cast("binary")), _sha(whole(text_col).cast("binary"))))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), leaf.alias("leaf"), F.octet_length(whole(text_col)).cast("long").alias("n_bytes"))
    # Written first: the range partitioning reads its input twice, once for its bounds.
    digests = stages.write(rows, "digests")
    parts, order = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["conv_id", "turn", "leaf"]
    dealt = digests.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    turns = stages.write(dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "leaf", "n_bytes"), "turns")
    stages.drop(digests)
    mine = Window.partitionBy("conv_id")
    runs = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.select("conv_id", "part", "first", (F.sum("n").over(mine.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(mine).alias("n_turns"))
    return turns, stages.write(runs, "runs")


def positioned(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """``turns`` with pos (from 1 in each conversation) and the columns of ``runs``."""
    pos = F.col("at") - F.col("first") + F.col("before") + 1
    return turns.join(runs, ["conv_id", "part"]).withColumn("pos", pos).drop("part", "at", "first", "before")


def chains(turns: DataFrame, stages: Stages, longest: int, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, k, digests and n_bytes: for each block of turns, the digest before it and those after each of its turns."""
    k = F.floor((F.col("pos") - 1) / block).cast("long")
    held = F.sort_array(F.collect_list(F.struct("pos", "leaf", "n_bytes")))
    blocks = turns.groupBy("conv_id", "n_turns", k.alias("k")).agg(held.alias("t"))
    step = lambda done, t: F.array_append(done, _sha(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(b"")), t["leaf"])))
    blocks = blocks.select("conv_id", "n_turns", "k", F.aggregate("t", F.array().cast("array<binary>"), step).alias("own"), F.col("t.n_bytes").alias("n_bytes"))
    if longest > block:
        blocks = stages.write(blocks, "blocks")
        ends = blocks.where((F.col("k") + 1) * block < F.col("n_turns")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", F.element_at("own", -1).alias("end")))).alias("ends"))
        upto = F.aggregate("ends", F.array(_root()), lambda done, e: F.array_append(done, _sha(F.concat(F.element_at(done, -1), e["end"]))))
        starts = ends.select("conv_id", F.posexplode(upto).alias("k", "start")).where("k > 0").select("conv_id", F.col("k").cast("long").alias("k"), "start")
        later = blocks.where("k > 0").join(starts, ["conv_id", "k"])
        blocks = blocks.where("k = 0").withColumn("start", _root()).unionByName(later)
    else:
        blocks = blocks.withColumn("start", _root())
    digests = F.concat(F.array("start"), F.transform("own", lambda c: _sha(F.concat(F.col("start"), c))))
    return stages.write(blocks.select("conv_id", "n_turns", "k", digests.alias("digests"), "n_bytes"), "chains")


def end_digests(ends: DataFrame, parts: int) -> DataFrame:
    """(digest, ends_sha256) from (digest, conv_id): SHA-256 of the ids in ascending order, joined by commas."""

    def strings(batches):
        key, first, ids, out = None, None, [], []
        for batch in batches:
            for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (digest != key or len(ids) == CHUNK):
                    out.append((key, first, ",".join(ids)))
                    ids = []
                if not ids:
                    key, first = digest, conv
                ids.append(str(conv))
            if out:
                yield _rows(out, ["digest", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])
                out = []
        if ids:
            yield _rows([(key, first, ",".join(ids))], ["digest", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])

    def hashed(batches):
        key, running, out = None, None, []
        for batch in batches:
            for digest, ids in zip(batch.column(0), batch.column(1)):
                digest, ids = digest.as_py(), ids.as_py().encode()
                if digest == key:
                    running.update(b"," + ids)
                    continue
                if key is not None:
                    out.append((key, running.hexdigest()))
                key, running = digest, hashlib.sha256(ids)
            if out:
                yield _rows(out, ["digest", "ends_sha256"], [pa.binary(), pa.string()])
                out = []
        if key is not None:
            yield _rows([(key, running.hexdigest())], ["digest", "ends_sha256"], [pa.binary(), pa.string()])

    ordered = ends.select("digest", "conv_id").repartitionByRange(parts, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    joined = ordered.mapInArrow(strings, "digest binary, first long, ids string")
    dealt = joined.repartition(parts, "digest").sortWithinPartitions("digest", "first").select("digest", "ids")
    return dealt.mapInArrow(hashed, "digest binary, ends_sha256 string")


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def subtree_sums(nodes: DataFrame, names: list[str], stages: Stages, deepest: int, levels: int = LEVELS) -> DataFrame:
    """(digest, names): each of the columns ``names`` of ``nodes`` summed over all nodes of a subtree, its top included."""
    sums = [F.sum(n).alias(n) for n in names]
    top = F.col("depth") % levels == 0
    near = nodes.select(F.explode(F.when(top, F.array("digest")).otherwise(F.col("up"))).alias("digest"), *names).groupBy("digest").agg(*sums)
    if deepest < levels:
        return near
    near = stages.write(near, "near")
    tops = nodes.where(top).select("digest", "up", F.when(F.col("depth") > 0, F.col("up")[0]).alias("above")).join(near, "digest")
    ranks = tops.select("digest", "above", *names)
    reach = 1
    while reach <= deepest // levels:  # each round doubles the distance that sums have come
        ranks = stages.write(ranks, "ranks")
        add = ranks.where("above is not null").groupBy(F.col("above").alias("digest")).agg(*[F.sum(n).alias(f"_{n}") for n in names])
        over = ranks.select(F.col("digest").alias("above"), F.col("above").alias("next"))
        ranks = ranks.join(add, "digest", "left").join(over, "above", "left").select("digest", F.col("next").alias("above"), *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names])
        reach *= 2
    lower = stages.write(ranks, "ranks").join(tops.where("above is not null").select("digest", "up"), "digest")
    passed = lower.select(F.explode(F.slice("up", F.lit(1), F.size("up") - 1)).alias("digest"), *names)
    return near.unionByName(passed).groupBy("digest").agg(*sums)


def build(turns: DataFrame, convs: DataFrame, stages: Stages, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """The trie's nodes, one row each, from ``turns`` (conv_id, pos, n_turns, leaf, n_bytes) and ``convs`` (conv_id, n_turns, with turnless ones).

    digest and depth name a node; conv_id is its smallest member. n_convs, n_children and n_leaves count members, children and
    childless nodes of the subtree; saved_tokens sums, over the subtree, the bytes of a node's last text for all members but one.
    ``block`` has to be a multiple of ``levels``.
    """
    deepest = convs.agg(F.coalesce(F.max("n_turns"), F.lit(0))).first()[0]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chained = chains(turns, stages, deepest, block)
    depth, start = F.col("k") * block + F.col("i") + 1, F.floor((F.col("k") * block + F.col("i")) / levels) * levels
    laid = chained.select("conv_id", "k", "digests", F.posexplode("n_bytes").alias("i", "n_bytes"))
    up = F.slice("digests", (start - F.col("k") * block + 1).cast("int"), (depth - start + 1).cast("int"))
    prefixes = laid.select("conv_id", depth.cast("long").alias("depth"), "n_bytes", up.alias("up"))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), F.array(_root()).alias("up"))
    grouped = prefixes.unionByName(roots).groupBy("depth", F.element_at("up", -1).alias("digest"))
    nodes = stages.write(grouped.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes"), F.first("up").alias("up")), "nodes")
    parent = F.when(F.col("depth") > 0, F.element_at("up", -2))
    children = stages.write(nodes.where("depth > 0").groupBy(parent.alias("parent")).agg(F.count("*").alias("n_children")), "children")
    counted = nodes.join(children.withColumnRenamed("parent", "digest"), "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    counted = counted.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
    counted = stages.write(counted.withColumn("parent", parent), "counted")
    sums = subtree_sums(counted, ["n_leaves", "saved_tokens"], stages, deepest, levels)
    last = chained.where(F.col("k") * block + F.size("n_bytes") == F.col("n_turns")).select(F.element_at("digests", -1).alias("digest"), "conv_id")
    ends = end_digests(last.unionByName(convs.where("n_turns = 0").select(_root().alias("digest"), "conv_id")), parts)
    rows = counted.select("digest", "parent", "depth", "conv_id", "n_convs", "n_children").join(sums, "digest").join(ends, "digest", "left")
    rows = stages.write(rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "summed")
    named = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = join_spread(rows.where("depth > 0"), named, "parent", heavy_keys(children, "parent", "n_children", least=1000))
    top = rows.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(top).drop("parent")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """The prefix trie of ``conversations`` as they are."""
    stages = Stages(conversations.sparkSession, "prefix-trie")
    turns, runs = number_turns(conversations, stages, conv_col, turn_col, role_col, text_col)
    return build(positioned(turns, runs), runs.where("before = 0").select("conv_id", "n_turns"), stages, block, levels)


def shared_heads(turns: DataFrame, runs: DataFrame, stages: Stages, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as the first ``head`` turns of conversation ``base`` (both from conv_id), then their own after as many.

    ``most``: a bound of ``head``, so at most so many rows of a base meet the conversations that take them. Returns (turns, convs) for ``build``.
    """
    own = runs.where("before = 0").select("conv_id", "n_turns", base.alias("base"), head.cast("long").alias("h"))
    known = runs.where("before = 0").select(F.col("conv_id").alias("base"), F.col("n_turns").alias("of_base"))
    taken = F.least("h", F.coalesce("of_base", F.lit(0).cast("long")))
    plan = own.join(known, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0).cast("long"))).alias("whole"))
    plan = stages.write(plan, "plan")
    placed = stages.write(positioned(turns, runs.drop("n_turns").join(plan, "conv_id")), "placed")
    stages.drop(turns)
    kept = placed.where(F.col("pos") > F.col("h")).select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), F.col("whole").alias("n_turns"), "leaf", "n_bytes")
    heads = placed.where((F.col("pos") <= most) & (F.col("conv_id") == F.col("base"))).select("base", "pos", "leaf", "n_bytes")
    lent = plan.where("taken > 0").join(heads, "base").where(F.col("pos") <= F.col("taken")).select("conv_id", "pos", F.col("whole").alias("n_turns"), "leaf", "n_bytes")
    return kept.unionByName(lent), plan.select("conv_id", F.col("whole").alias("n_turns"))
