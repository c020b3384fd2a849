import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import prefix_counts, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "\n", "a\n\n b", "a  b \n", "z\x85y\xa0z", "<|endoftext|> hi", "a <|endoftext|> b", "<|STARTOFTEXT|>x<|endoftext|><|endoftext|>", "<|endoftext", "a\x00b", "it's we'll  'tis ,'s don't they'RE !!'ve 're"]
TEXTS += ["\x1c\x1d a", "日本 語，は", "é é x́É,", "İSTANBUL ΣΑΣ", "x" * 300, "THIS!! is*** ok%%% a | b ×,÷. don''t ≠≠ ≠", "각각 Å Å", "́ \ń", "aaaaaaabbbbbbbababa", "👍🏽 12345 a1b2"]


def plain(tok, text):
    return [len(e.ids) for e in tok.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


def test_every_prefix_equals_the_library():
    rng, tok = random.Random(13), Tokenizer.from_file(PATH)
    odd = ["".join(rng.choice("abcdeést'rlvmd!.,<|> \n12ÉΣ日́≠") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 25))) for _ in range(400)]
    for own in (prefix_counts.PrefixCounter(PATH), prefix_counts.PrefixCounter(PATH, most=50)):
        for text, got in zip(TEXTS + odd + words, own.counts(pa.array(TEXTS + odd + words))):
            assert got.tolist() == plain(tok, text), repr(text)


def test_counts_may_fall_and_steps_come_back():
    own = prefix_counts.PrefixCounter(PATH)
    counts = own.counts(pa.array(["<|endoftext|>"]))[0]
    assert counts[-1] == 1 < counts[-2] and prefix_counts.within(counts, 1) == 13
    for values in ([0], [0, 1, 1, 2, 1], [0, 300, 2], [0, 70_000, 1]):
        assert prefix_counts.unpack_steps(prefix_counts.pack_steps(pa.array(values).to_numpy())).tolist() == values


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        prefix_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        prefix_counts.Merges({"a": 0, "b": 1, "c": 2, "bc": 3, "abc": 4}, [("a", "bc"), ("b", "c")], "</w>")
    with pytest.raises(RuntimeError):
        prefix_counts.PrefixCounter(PATH).check(["one two"], [3])


def test_operator_over_odd_rows(spark, odd_docs, no_docs):
    tok = Tokenizer.from_file(PATH)
    clash = odd_docs.withColumn("n_tokens", F.lit("x")).withColumn("kept_chars", F.lit(1)).withColumn("prefix_steps", F.lit(2.0))
    found = prefix_counts.add_prefix_counts(clash, PATH, budget=5)
    rows = found.collect()
    assert len(rows) == odd_docs.count() and {"fp", "score", "start", "lang"} <= set(found.columns) and len(found.columns) == len(clash.columns)
    for r in rows:
        text = r.text or ""
        assert r.n_tokens == len(tok.encode(text, add_special_tokens=False).ids)
        counts = prefix_counts.unpack_steps(r.prefix_steps)
        assert len(counts) == len(text) + 1 and counts[-1] == r.n_tokens and r.kept_chars == max(i for i, n in enumerate(counts) if n <= 5)
    for r in prefix_counts.cut(found, 3).collect():
        assert len(tok.encode(r.truncated, add_special_tokens=False).ids) <= 3 and (r.text or "").startswith(r.truncated)
    for r in prefix_counts.tokens_at(found.withColumn("p", F.lit(7)), "p").collect():
        assert r.tokens_at == (len(tok.encode(r.text[:7], add_special_tokens=False).ids) if r.text is not None and len(r.text) >= 7 else None)
    assert prefix_counts.add_prefix_counts(no_docs, PATH).count() == 0


def test_query_equals_the_library(spark):
    at, tok = "/root/testdata/sf0.001", Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{at}/documents.parquet").collect()
    want = {d.doc_id: (len((d.text or "").encode()), len(tok.encode(d.text or "", add_special_tokens=False).ids)) for d in docs}
    found = queries.op13_token_counts(spark, at).collect()
    assert len(found) == len(docs) and {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found)
    text = {d.doc_id: d.text or "" for d in docs}
    for r in found:
        assert (r.kept_chars == len(text[r.doc_id])) if not r.over_limit else len(tok.encode(text[r.doc_id][: r.kept_chars], add_special_tokens=False).ids) <= 2048
