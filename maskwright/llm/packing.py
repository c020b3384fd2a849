"""Packing token pieces into fixed-length sequences: first-fit decreasing within randomised groups.

Documents become ids and an end id, and are cut at multiples of the sequence length; full pieces fill a sequence alone.
The remainders are dealt to groups by a hash of a stored row number, so no key can gather rows, and each group of about
``group_rows`` is packed by first-fit decreasing. The first bin with room is found in a tournament tree over
bin capacities: the root knows the largest free room, and a descent to the left where it suffices takes log n steps.

Defined results: a null or empty text is its end id alone; a very long text becomes many full pieces and one remainder;
repeated rows are packed each; equal lengths are placed in the order of their row numbers; an empty table gives an empty result;
extra columns of the pieces table pass through the packing, those named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import tokens
from maskwright.llm.runtime import Stages, trim, without


class CapacityTree:
    """Bins numbered from 0 with equal capacity; ``place(n)`` returns the first bin with room for n."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        best, node = self.best, 1
        if best[1] < size:
            raise ValueError("no bin has room")
        while node < self.width:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        leaf = node - self.width
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return leaf


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, longest first; ties keep their order. Sizes lie in 1..capacity."""
    order = np.argsort(-sizes, kind="stable")
    # First fit leaves at most one bin half empty, so twice the content bounds the bins.
    tree = CapacityTree(int(min(len(sizes), 2 * sizes.sum() // capacity + 1)), capacity)
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), {}
    for k in order.tolist():
        size = int(sizes[k])
        b = tree.place(size)
        bins[k], offsets[k] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + size
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, text_col: str = "text", id_col: str = "doc_id", most: int = 800_000) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (uint32 little-endian bytes) of every piece of every document.

    ``most`` bounds the distinct stretches that a worker remembers.
    """

    def cut(batches):
        coder, end = tokens.encoder(tokenizer, most), np.array([end_id], np.uint32)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                trim()
                batch = whole.slice(lo, 256)
                docs, starts, lengths, totals, ids = [], [], [], [], []
                for doc, found in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                    all_ids = np.concatenate([found, end]).astype("<u4")
                    for a in range(0, len(all_ids), capacity):
                        piece = all_ids[a : a + capacity]
                        docs.append(doc)
                        starts.append(a)
                        lengths.append(len(piece))
                        totals.append(len(all_ids))
                        ids.append(piece.tobytes())
                longs = [pa.array(x, pa.int64()) for x in (docs, starts, lengths, totals)]
                yield pa.RecordBatch.from_arrays([*longs, pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(pieces: DataFrame, capacity: int = 1024, group_rows: int = 8192) -> DataFrame:
    """``pieces`` (length in 1..capacity, any other columns) with sequence_id and offset."""
    stages = Stages(pieces.sparkSession, "packing")
    rows = stages.write(without(pieces, "sequence_id", "offset", "grp", "rid").withColumn("rid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_rows))
    # A stored row number is hashed, not a document's columns: equal rows still spread over all groups.
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(groups)))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid", kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(np.int64), capacity)
        return part.assign(sequence_id=part["grp"].to_numpy(np.int64) * (1 << 32) + bins, offset=offsets).drop(columns=["grp", "rid"])

    kept = [f for f in rows.schema.fields if f.name not in ("grp", "rid")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return rows.groupBy("grp").applyInPandas(fit, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, keep_ids: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every piece of every document with its place; ids_crc32 is the unsigned crc32 of its ids, which stay where asked for."""
    # Groups that carry ids hold four bytes a token, so they are smaller, and workers remember less beside them.
    pieces = token_pieces(docs, tokenizer, end_id, capacity, text_col, id_col, 400_000 if keep_ids else 800_000).withColumn("ids_crc32", F.crc32("ids"))
    return pack(pieces, capacity, 2048) if keep_ids else pack(pieces.drop("ids"), capacity)
