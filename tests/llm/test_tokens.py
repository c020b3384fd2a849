import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import dac, packing, queries
from maskwright.llm.tokens import Encoder

TEXTS = ["", " ", "\n", "a\n\n b", "a  b \n", "\n\nx", "x\x85y\xa0z", "<|endoftext|> hi", "a <|endoftext|> b", "<|STARTOFTEXT|>x<|endoftext|><|endoftext|>", "a\x00b", "it's we'll  'tis ,'s", "\x1c\x1d a", "\t\tx\t y", "日本 語，は", "é ́x É,", "İSTANBUL ΣΑΣ", None, "a\r\n\r\nb  ", "x" * 3000, "THIS!! is*** ok%%% a | b ×,÷. don''t ≠≠"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_equals_whole_encoding(spark, name):
    path = f"{queries.TOKENIZERS}/{name}"
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    plain = Tokenizer.from_file(path)
    want = [e.ids for e in plain.encode_batch([t or "" for t in TEXTS + docs], add_special_tokens=False)]
    for most in (100, 1_000_000):
        got = Encoder(path, most=most).encode(pa.array(TEXTS + docs))
        assert [g.tolist() for g in got] == want


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 70000, 3, 1 << 31], list(range(3000))])
def test_segment_round_trip(values):
    values = np.array(values, np.uint32)
    seg = dac.Segment(dac.encode_segment(values))
    assert seg.decode().tolist() == values.tolist()
    assert [seg[i] for i in range(len(seg))] == values.tolist()
    with pytest.raises(IndexError):
        seg[len(values)]


def test_random_access_in_a_long_segment():
    rng = np.random.default_rng(3)
    values = (2 ** (rng.random(20000) * 16)).astype(np.uint32)
    raw = dac.encode_segment(values)
    seg = dac.Segment(raw)
    assert len(seg.levels) > 1 and len(raw) < 2 * len(values)
    assert all(seg[i] == values[i] for i in rng.integers(0, 20000, 500).tolist())
    with pytest.raises(ValueError):
        dac.Segment(raw[:-1])


def test_written_corpus_reads_back(spark, tmp_path, odd_docs, no_docs):
    path = os.path.join(queries.TOKENIZERS, "word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for docs, at in ((odd_docs, "odd"), (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "docs"), (no_docs, "none")):
        out = f"file://{tmp_path}/{at}"
        dac.write_corpus(docs, out, path, end_id=2, segment_tokens=700)
        rows = dac.read_documents(spark, out, with_ids=True).orderBy("start").collect()
        want = sorted(((d.doc_id is not None, d.doc_id or 0, d.text or "") for d in docs.collect()))
        ids = [plain.encode(t, add_special_tokens=False).ids + [2] for _, _, t in want]
        assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [w[:2] for w in want]
        assert [r.ids for r in rows] == ids
        assert [r.start for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
        assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
        assert sorted(tuple(r) for r in dac.read_documents(spark, out).collect()) == sorted(tuple(r)[:4] for r in rows) if at != "odd" else True
        segments = dac.read_segments(spark, out)
        assert segments.where("n_tokens > 700 or before <> seq * size").count() == 0
        flat = [t for i in ids for t in i]
        asked = [0, 1, 699, 700, 701, len(flat) - 1, len(flat) // 2, len(flat) // 3, 5, 5, None, -1, len(flat)]
        found = {r.position: r.token for r in dac.tokens_at(spark.createDataFrame([(a,) for a in asked], "position long"), out).collect()}
        assert found == {a: flat[a] for a in asked if a is not None and 0 <= a < len(flat)}
        if flat:
            assert [dac.token_at(spark, out, a) for a in (0, 700, len(flat) - 1)] == [flat[0], flat[700], flat[-1]]
        with pytest.raises(IndexError):
            dac.token_at(spark, out, len(flat))


def slow_first_fit(sizes, capacity):
    free, out = [], []
    for s in sorted(sizes, reverse=True):
        for k, room in enumerate(free):
            if room >= s:
                free[k] -= s
                out.append(k)
                break
        else:
            free.append(capacity - s)
            out.append(len(free) - 1)
    return out


def test_first_fit_decreasing_matches_a_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        sizes = rng.integers(1, 101, n)
        bins, _ = packing.first_fit_decreasing(sizes, 100)
        assert bins[np.argsort(-sizes, kind="stable")].tolist() == slow_first_fit(sizes.tolist(), 100)


def check_packed(rows, docs, path, end):
    plain = Tokenizer.from_file(path)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in rows)
    want = []
    for d in docs:
        ids = plain.encode(d.text or "", add_special_tokens=False).ids + [end]
        for a in range(0, len(ids), 1024):
            want.append((d.doc_id is not None, d.doc_id or 0, a, len(ids[a : a + 1024]), len(ids), zlib.crc32(np.array(ids[a : a + 1024], "<u4").tobytes())))
    assert got == sorted(want)
    return sum(r.length for r in rows) / (1024 * len(by_seq))


def test_packing_query(spark, odd_docs, no_docs):
    path = os.path.join(queries.TOKENIZERS, "byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    filled = check_packed(queries.op7_packing(spark, "/root/testdata/sf0.001").collect(), docs, path, 0)
    assert filled > 0.97
    odd = packing.pack_documents(odd_docs, path, 0)
    check_packed(odd.collect(), odd_docs.collect(), path, 0)
    assert odd.where(F.crc32("ids") != F.col("ids_crc32")).count() == 0
    assert packing.pack_documents(no_docs, path, 0).count() == 0
