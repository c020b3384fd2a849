"""Findings of the fourth round; each test failed before its change."""

from collections import Counter

import duckdb
import pytest

from pyspark.sql import functions as F

from maskwright.functions import detectors
from maskwright.functions import text as T
from maskwright.operators import image, textmap, words
from maskwright.plans import catalog, joined, pictures

# A card, an address and a number that stand alone and as parts of longer runs of their line.
DOCUMENTS = [(1, "a 4111 1111 1111 1111 b"), (2, "4111 1111 1111 1111 x 5 4111 1111 1111 1111"), (3, "u@ex.com w.u@ex.com"), (4, "10.0.0.1 and 10.0.0.1:80"), (5, "4111111111111111, 4111111111111111 12")]
# Turns that hold a name, a number, their own address, alone and within a longer one; and a conversation without a number.
TURNS = [(1, 1, "user", "ask enes eren"), (2, 1, "user", "vergi no 0505050580"), (3, 1, "user", "from u3@mail.example.com"), (5, 2, "user", "5@mail.example.com xu5@mail.example.com"), (None, 1, "user", "hi"), (None, 2, None, None), (-4, 1, "user", "in")]


@pytest.mark.parametrize("name", ["credit_card_detections", "email_detections", "ipv4_detections", "conversation_detections"])
def test_equals_its_sql_where_values_stand_twice(spark, tmp_path, name):
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    made = catalog.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    rows = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    assert Counter(tuple(r) for r in made.select(*columns).collect()) == Counter(rows.fetchall())


def test_burnt_pictures_never_leave_their_task(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(40)], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.queries()["burnt_pictures"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "pixels" not in plan  # batches of pictures grew with the rows of a task
    gray = pictures.drawn(33)
    boxes = [{"x": 33.0, "y": 3.0, "w": 60.0, "h": 20.0, "style": "blackout", "strength": None}, {"x": 420.0, "y": 40.0, "w": 60.0, "h": 20.0, "style": "pixelate", "strength": 6.0}]
    row = made.where("doc_id = 33").first()
    assert row.pixel_sum == int(image.painted(gray, boxes).sum()) and row.pixel_sum < int(gray.sum())
    assert made.count() == 40


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cut_words_are_shuffled_once(spark, tmp_path):
    spark.range(1, 40).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert _exchanges(joined.values_over_words(spark, str(tmp_path))) == 1  # each window shuffled runs and matches anew
    assert _exchanges(joined.boxes_of_matches(spark, str(tmp_path))) == 2  # words and matches, once each


def test_what_a_beginning_holds_the_whole_may_hold(spark):
    parts = ["call +1", "(212)", "555-", "0147 x", "u1", "@mail.", "example.com", "10.", "3.", "77.1", "4000", "0001 2345", "67890", "ssn:", "123-45-", "6789", "sess_", "kabc1234", "by", "Ahmet", "Stone", "sk_live_", "4abcdefghijkmnpq", "7abcdefghijkmnpq", "City:", "Lakeside", "in", "Ankara", "Name:", "Maya", "İli"]
    rows = [(" ".join(parts[a:b]), "".join(parts[a:b]), " ".join(parts[a:e]), "".join(parts[a:e])) for a in range(len(parts)) for b in range(a + 1, min(a + 5, len(parts) + 1)) for e in range(b, min(a + 8, len(parts)) + 1)]
    every = words.CUT_WORDS
    bits = lambda c: detectors.may_begin(F.col(c), F.lower(c), T.fold_turkish(F.col(c)), every)
    marked = spark.createDataFrame(rows, "s string, g string, ws string, wg string").select("*", F.monotonically_increasing_id().alias("id"), bits("s").alias("bs"), bits("g").alias("bg"), bits("ws").bitwiseOR(bits("wg")).alias("bw"))
    table = marked.localCheckpoint()
    assert table.where((F.col("bs").bitwiseOR(F.col("bg")).bitwiseAND(F.bitwise_not("bw"))) != 0).count() == 0
    for c, b in (("s", "bs"), ("g", "bg")):
        found = detectors.detect(table, ["id", b], c, rules=(), only=every).select(b, "type").distinct().collect()
        assert found and all(r[b] & detectors.type_bits([r.type], every) for r in found)


def test_readings_made_once_give_the_same_places(spark):
    texts = ["pay DE 00-12 Maya’nın end", "a_b  c-d", "tel O 585 123 45 67 x", "İstanbul’da IĞDIR", "", "x", "mid - 7", "😀 ok - 1", "0 585_1234567 O 1"]
    values = ["payde0012", "de 0012", "maya", "end", "abcd", "b c", "05851234567", "0585 123 45 67", "istanbul", "igdir", "", " ", "mid7", "ok1", "-", "nowhere", "O 1", "0 1"]
    rows = spark.createDataFrame([(t, v) for t in texts for v in values], "t string, v string")
    t, v = F.col("t"), F.col("v")
    made = rows.select("t", "v", textmap.match_range(t, v, F.lit(0)).alias("a"), textmap._readings(t).alias("_r")).select("t", "v", "a", textmap._first_range(t, F.col("_r"), v).alias("b")).collect()
    assert [(r.t, r.v, r.a) for r in made] == [(r.t, r.v, r.b) for r in made] and sum(r.a is not None for r in made) > 15
