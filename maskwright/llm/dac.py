"""Token ids in directly addressable codes: random access to any token without decoding a block.

A segment holds the ids of consecutive documents. Each id is split into chunks, low bits first; level l stores the l-th
chunk of every id that is long enough, a bitmap marks the ids that continue on the next level, and a rank directory
(set bits before every 512th position) turns a position on one level into the position on the next. Chunk widths come
from a dynamic programme over the segment's id lengths, so that the sum of chunks, bitmaps and directories is least.

Segment bytes, little-endian: ``DAC1``, uint64 count, uint8 levels, then for each level uint8 width and uint64 count,
then for each level the packed chunks, and for all but the last the bitmap and its uint32 directory.

A written corpus is a Parquet folder of segments: part, seq, size, n_tokens, before (tokens earlier in the part), payload, and the
documents that lie in it, wholly or in part: doc_ids, starts (within the part), lengths. Parts are ranges of ascending document id; Spark's
commit protocol makes a part whole or absent. All segments of a part but its last hold exactly ``size`` tokens, whatever the documents' lengths,
so the segment of a token is a division; payloads are not compressed and have a page each, so a reader that asks for one segment
is led to its page by the columns' indexes. ``token_at`` and ``tokens_at`` read tokens by their place in the corpus that way.

Defined results: null and empty texts hold only the end id; rows with a null id come first; repeated ids keep all of
their rows, in an order fixed by text; an empty table gives an empty folder; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm import tokens
from maskwright.llm.runtime import Stages, bounded_broadcast, trim

MAGIC = b"DAC1"
RANK = 512
SEGMENTS = "part int, seq int, size int, n_tokens long, before long, doc_ids array<long>, starts array<long>, lengths array<long>, payload binary"


def chunk_widths(values: np.ndarray) -> list[int]:
    """Widths, low chunk first, that store ``values`` in the fewest bits."""
    top = max(1, int(values.max()).bit_length()) if len(values) else 1
    lengths = np.frexp(values.astype(np.float64))[1] if len(values) else np.zeros(0, int)
    longer = [int((lengths > b).sum()) for b in range(top + 1)]
    longer[0] = len(values)  # every id has a first chunk
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for done in range(top - 1, -1, -1):
        options = []
        for w in range(1, top - done + 1):
            more = done + w < top
            options.append((longer[done] * (w + (1 + 32 / RANK) * more) + best[done + w][0], [w, *best[done + w][1]]))
        best[done] = min(options)
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    out = np.empty((len(values), width), np.uint8)
    for b in range(width):
        out[:, b] = values >> np.uint32(b) & np.uint32(1)
    return np.packbits(out.ravel(), bitorder="little").tobytes()


def encode_segment(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, np.uint32)
    widths, rest, heads, bodies = chunk_widths(values), values, [], []
    for level, width in enumerate(widths):
        heads.append(struct.pack("<BQ", width, len(rest)))
        bodies.append(_pack(rest & np.uint32((1 << width) - 1), width))
        if level + 1 < len(widths):
            high = rest >> np.uint32(width)
            on = high > 0
            bodies.append(np.packbits(on, bitorder="little").tobytes())
            sums = np.add.reduceat(on, np.arange(0, len(on), RANK)) if len(on) else np.zeros(0, int)
            bodies.append((np.cumsum(sums) - sums).astype("<u4").tobytes())
            rest = high[on]
    return MAGIC + struct.pack("<QB", len(values), len(widths)) + b"".join(heads) + b"".join(bodies)


class Segment:
    """A reader over a segment's bytes: ``seg[i]`` touches a few bytes a level, ``seg.decode()`` reads all."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a DAC1 segment")
        self.raw = raw
        self.n, levels = struct.unpack_from("<QB", raw, 4)
        heads = [struct.unpack_from("<BQ", raw, 13 + 9 * k) for k in range(levels)]
        at, self.levels = 13 + 9 * levels, []
        for k, (width, n) in enumerate(heads):
            chunks, at = at, at + (n * width + 7) // 8
            bits, at = at, at + ((n + 7) // 8 if k + 1 < levels else 0)
            ranks, at = at, at + (4 * -(-n // RANK) if k + 1 < levels else 0)
            self.levels.append((width, n, chunks, bits, ranks))
        if at != len(raw):
            raise ValueError("truncated DAC1 segment")

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for k, (width, _, chunks, bits, ranks) in enumerate(self.levels):
            first, last = i * width // 8, ((i + 1) * width + 7) // 8
            word = int.from_bytes(self.raw[chunks + first : chunks + last], "little")
            value |= (word >> (i * width % 8) & ((1 << width) - 1)) << shift
            shift += width
            if k + 1 == len(self.levels) or not self.raw[bits + i // 8] >> (i % 8) & 1:
                break
            block = i // RANK
            before = struct.unpack_from("<I", self.raw, ranks + 4 * block)[0]
            part = int.from_bytes(self.raw[bits + block * RANK // 8 : bits + i // 8 + 1], "little")
            i = before + (part & ((1 << (i - block * RANK)) - 1)).bit_count()
        return value

    def decode(self) -> np.ndarray:
        high = None
        for k in range(len(self.levels) - 1, -1, -1):
            width, n, chunks, bits, _ = self.levels[k]
            packed = np.frombuffer(self.raw, np.uint8, (n * width + 7) // 8, chunks)
            each = np.unpackbits(packed, count=n * width, bitorder="little").reshape(n, width)
            low = np.zeros(n, np.uint32)
            for b in range(width):
                low |= each[:, b].astype(np.uint32) << np.uint32(b)
            if high is not None:
                on = np.unpackbits(np.frombuffer(self.raw, np.uint8, (n + 7) // 8, bits), count=n, bitorder="little").astype(bool)
                low[on] |= high << np.uint32(width)
            high = low
        return high if high is not None else np.zeros(0, np.uint32)


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int, text_col: str = "text", id_col: str = "doc_id", segment_tokens: int = 1 << 18) -> None:
    """Encodes every text of ``docs``, appends ``end_id``, and writes segments of ``segment_tokens`` in ascending id order under ``path``."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    dealt = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "t")

    def segments(batches):
        coder, part = tokens.encoder(tokenizer, most=1_000_000), TaskContext.get().partitionId()
        end, docs, held, waiting, seq, place = np.array([end_id], np.uint32), [], [], 0, 0, 0

        def flush():
            nonlocal docs, held, waiting, seq
            flat = np.concatenate(held)
            flat, rest = flat[:segment_tokens], flat[segment_tokens:]
            before, upto = seq * segment_tokens, seq * segment_tokens + len(flat)
            ids, starts, lengths = zip(*[d for d in docs if d[1] < upto])
            row = [[part], [seq], [segment_tokens], [len(flat)], [before], [list(ids)], [list(starts)], [list(lengths)], [encode_segment(flat)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            docs, held, waiting, seq = [d for d in docs if d[1] + d[2] > upto], [rest], len(rest), seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "seq", "size", "n_tokens", "before", "doc_ids", "starts", "lengths", "payload"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                trim()
                batch = whole.slice(lo, 2048)
                for doc, found in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                    docs.append((doc, place, len(found) + 1))
                    held += [found, end]
                    place, waiting = place + len(found) + 1, waiting + len(found) + 1
                    while waiting >= segment_tokens:
                        yield flush()
        if waiting:
            yield flush()

    written = dealt.mapInArrow(segments, SEGMENTS).write
    written.option("compression", "uncompressed").option("parquet.page.row.count.limit", "1").parquet(path)


def _part_starts(rows: DataFrame) -> DataFrame:
    """part, part_first: the tokens before each part. One row a part (a shuffle partition of the writer), so the running sum stays small."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_first"), "n")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``first``: the tokens of the whole corpus before their part."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    offsets = _part_starts(rows).select("part", F.col("part_first").alias("first"))
    return rows.join(bounded_broadcast(offsets, offsets.count()), "part")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files; ``ids`` too where asked for.

    Segments are decoded once; documents that go over a segment's end come out in pieces, which are few and meet by their start.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "seq", "raw"]

    def documents(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                trim()
                first, seq, before, held, docs, starts, sizes, raw = (batch.column(c)[k].as_py() for c in ("first", "seq", "before", "n_tokens", "doc_ids", "starts", "lengths", "payload"))
                ids = Segment(raw).decode().astype("<u4")
                starts, sizes = np.array(starts), np.array(sizes)
                begin, stop = np.maximum(starts - before, 0), np.minimum(starts + sizes - before, held)
                whole = stop - begin == sizes
                pieces = [ids[a:b].tobytes() for a, b in zip(begin, stop)]
                crcs = [zlib.crc32(p) if w else None for p, w in zip(pieces, whole)]
                kept = [None if w and not with_ids else p for p, w in zip(pieces, whole)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + starts), pa.array(sizes), pa.array(crcs, pa.int64()), pa.array([seq] * len(docs), pa.int32()), pa.array(kept, pa.binary())], names=names)

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        raw = b"".join(group["raw"].to_pylist())
        return pa.table([group["doc_id"][:1], group["start"][:1], group["n_tokens"][:1], pa.array([zlib.crc32(raw)], pa.int64()), group["seq"][:1], pa.array([raw], pa.binary())], names=names)

    def shown(batches):
        for batch in batches:
            ids = [np.frombuffer(r, "<u4").tolist() for r in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int64()))], names=[*names[:4], "ids"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, seq int, raw binary"
    rows = read_segments(spark, path).select("first", "seq", "before", "n_tokens", "doc_ids", "starts", "lengths", "payload").mapInArrow(documents, schema)
    rows = Stages(spark, "dac-read").write(rows, "documents")
    found = rows.where("ids_crc32 is not null").unionByName(rows.where("ids_crc32 is null").groupBy("start").applyInArrow(joined, schema))
    if not with_ids:
        return found.select(*names[:4])
    return found.mapInArrow(shown, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def tokens_at(wanted: DataFrame, path: str, column: str = "position") -> DataFrame:
    """(position, token) of every distinct place of the corpus in ``column`` of ``wanted``; places outside it are left out.

    A place's part is found among the parts' starts and its segment by a division; each asked segment is read once, and only a token's own bytes of it are looked at.
    """
    spark = wanted.sparkSession
    rows = spark.read.schema(SEGMENTS).parquet(path)
    starts = sorted((r.part_first, r.n, r.part) for r in _part_starts(rows).collect())
    size = rows.select("size").first()
    if size is None:
        return wanted.select(F.col(column).cast("long").alias("position"), F.lit(0).cast("long").alias("token")).limit(0)
    first, held, parts = (np.array(c) for c in zip(*starts))

    def addressed(batches):
        for batch in batches:
            at = np.asarray(batch.column(0))
            k = np.searchsorted(first, at, "right") - 1
            on = (k >= 0) & (at < (first + held)[k])
            place = (at - first[k])[on]
            yield pa.RecordBatch.from_arrays([pa.array(at[on]), pa.array(parts[k[on]], pa.int32()), pa.array((place // size[0]).astype(np.int32)), pa.array(place % size[0])], names=["position", "part", "seq", "at"])

    def picked(asked: pa.Table, segment: pa.Table) -> pa.Table:
        if not asked.num_rows or not segment.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=["position", "token"])
        codes = Segment(segment["payload"][0].as_py())
        return pa.table([asked["position"], pa.array([codes[i] for i in asked["at"].to_pylist()], pa.int64())], names=["position", "token"])

    asked = wanted.select(F.col(column).cast("long").alias("position")).where("position is not null").distinct().mapInArrow(addressed, "position long, part int, seq int, at long")
    return asked.groupBy("part", "seq").cogroup(rows.select("part", "seq", "payload").groupBy("part", "seq")).applyInArrow(picked, "position long, token long")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The token at one place of the corpus: one segment's page is read, and of it the token's own bytes."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    at = _part_starts(rows).where((F.col("part_first") <= position) & (F.col("part_first") + F.col("n") > position)).first()
    if position < 0 or at is None:
        raise IndexError(position)
    part = rows.where(F.col("part") == at.part)
    size, place = part.select("size").first()[0], position - at.part_first
    return Segment(part.where(F.col("seq") == place // size).select("payload").first()[0])[place % size]
