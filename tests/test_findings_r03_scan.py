"""Findings of round 3 on the scan: what is cut into words, and what is searched in full, are the lines that may hold a value."""

import re

from pyspark.sql import functions as F

from maskwright.functions import checks, fixed
from maskwright.functions.patterns import any_of
from maskwright.operators import pages
from maskwright.operators import words as W

K = ["doc_id", "page"]


def page(spark, *texts):
    return pages.lay_out(spark.createDataFrame([("d", "\n".join(texts))], "doc_id string, text string"))


def test_any_of_is_the_plain_alternation():
    for words in (fixed.PROVINCES, fixed.GIVEN_NAMES, fixed.PLACE_LABELS, ["a", "ab", "abc", "b"]):
        short = re.compile(any_of(words))
        assert all(short.fullmatch(w) for w in words)
        assert not any(short.fullmatch(w + "q") or short.fullmatch("q" + w) for w in words if w + "q" not in words and "q" + w not in words)


def test_lines_with_grouped_values_pass_and_prose_does_not(spark):
    held = ["pay GB82 WEST 1234  5698 7654 32 now", "card 4111 1111 1111 1111", "a.b @ex.com", "id 1000 0000 146", "n IOOO OOOO I46 x", "TR33 0006 1005 1978 6457 8413 26"]
    prose = ["nothing is here", "12 of 30 were so", "solos bis B8 slow", "REF-1234"]
    lines = page(spark, *held, *prose)
    found = {r.line_index for r in W.grouped_secrets(pages.words_of(lines, K), K).collect()}
    passed = {r.line_index for r in lines.where(W.may_be_grouped(F.col("text"))).collect()}
    assert set(range(len(held))) - {4} <= found <= passed == set(range(len(held)))


def test_pages_with_phones_pass_and_prose_does_not(spark):
    docs = spark.createDataFrame([(1, "tel: O 532 123 45 67"), (2, "no oo O 12 words"), (3, "call\n+90 532\n123 45 67"), (4, "0 5O2 x O O 1234")], "doc_id int, text string")
    lines = pages.lay_out(docs)
    few = W.may_hold_phones(lines, K)
    assert {r.doc_id for r in few.select("doc_id").distinct().collect()} == {1, 3}
    assert few.where("doc_id = 3").count() == 3
    every = lambda rows: sorted(map(str, W.phones_in_rows(pages.words_of(rows, K), K).collect()))
    assert every(few) == every(lines) != []


def test_labels_in_words_pass(spark):
    lines = page(spark, "Session   ID: sess_abc 123456", "API  key sk_live_" + "a1" * 12, "no label")
    assert {r.line_index for r in lines.where(W.may_be_beside(F.col("text"))).collect()} == {0, 1}


def test_only_lines_near_a_header_are_looked_at_as_key_bodies(spark):
    """Key bodies alone make no group, so nothing is shuffled for them."""
    lines = pages.lay_out(spark.createDataFrame([(i, "A" * 40) for i in range(50)], "doc_id int, text string"))
    plan = pages.private_keys(lines, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") <= plan.count("_body")
    before_join = plan.split("Join", 1)[1]
    assert "_body" not in before_join
    body = spark.createDataFrame([("A" * 40,), ("A b\tc+/=" * 5,), ("A" * 40 + ".",), ("short",), ("ü" * 30,)], "t string")
    assert [r[0] for r in body.select(checks.base64_line(F.col("t"))).collect()] == [True, True, False, False, False]
