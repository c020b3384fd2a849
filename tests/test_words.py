from pyspark.sql import functions as F

from maskwright.operators import pages, words as W

K = ["doc_id", "page"]


def page(spark, *texts):
    return pages.words_of(pages.lay_out(spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")), K)


def test_grouped_secrets(spark):
    rows = W.grouped_secrets(page(spark, "pay GB82 WEST 1234 5698 7654 32 now", "card 4111 1111 1111 1111", "a.b @ex.com", "id 1000 0000 146", "plain words"), K).orderBy("line_index").collect()
    assert [(r.line_index, r.type, r.rule_id, r.text, r.first_word) for r in rows] == [(0, "custom_rule", "iban", "GB82 WEST 1234 5698 7654 32", 1), (1, "credit_card", None, "4111 1111 1111 1111", 1), (2, "email", None, "a.b@ex.com", 0), (3, "tckn", "tckn", "10000000146", 1)]


def test_phones_over_rows(spark):
    rows = W.phones_in_rows(page(spark, "tel: O 532 123 45 67", "", "", "nothing 12"), K).collect()
    assert [(r.text, r.ocr_corrected, r.x0, r.x1) for r in rows] == [("0 532 123 45 67", True, 70.0, 250.0)]


def test_values_beside_labels(spark):
    rows = W.values_beside_labels(page(spark, "Session ID: sess_abc 123456", "API key sk_live_ " + "a1" * 12, "no label sess_abcdef1"), K).orderBy("line_index").collect()
    assert [(r.line_index, r.type, r.text) for r in rows] == [(0, "session_id", "sess_abc123456"), (1, "api_token", "sk_live_" + "a1" * 12)]


def test_second_pass(spark):
    df = spark.createDataFrame([(1, "10000000146"), (2, "9 10000000146"), (3, "123456789012"), (4, None)], "id int, text string")
    assert sorted((r.id, r.text) for r in W.second_pass_numbers(df, ["id"]).collect()) == [(1, "10000000146"), (2, "10000000146")]


def test_batch_labels(spark):
    rows = [(1, 1, "completed"), (1, 2, "processing"), (2, 1, "completed"), (2, 2, "failed"), (3, 1, "queued"), (4, 1, "completed")]
    got = {r.b: r.label for r in W.batch_label(spark.createDataFrame(rows, "b int, o int, status string"), ["b"], "o").collect()}
    assert got == {1: "Processing image 2 of 2...", 2: "2 images ready", 3: "Processing image 1 of 1...", 4: "1 image ready"}
