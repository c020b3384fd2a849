from maskwright.operators import pages, scan

K = ["doc_id", "page"]


def test_scan_of_a_page(spark):
    text = ["mail a.b@ex.com or call +90 532 123 45 67", "card 4111 1111 1111 1111", "pay TR33 0006 1005", "1978 6457 8413 26 soon", "Authorization: Bearer abcdef", "ghijklmnop123456", "Session ID: sess_abc 123456", "id REF-12345 end"]
    lines = pages.lay_out(spark.createDataFrame([(1, "\n".join(text)), (2, "nothing here"), (3, None)], "doc_id long, text string"))
    rows = scan.scan(lines, K).collect()
    assert {(r.doc_id, r.type, r.text) for r in rows} == {
        (1, "email", "a.b@ex.com"), (1, "phone", "+90 532 123 45 67"), (1, "credit_card", "4111 1111 1111 1111"), (1, "custom_rule", "TR33 0006 1005 1978 6457 8413 26"),
        (1, "bearer_token", "Bearer abcdefghijklmnop123456"), (1, "session_id", "sess_abc123456"), (1, "custom_rule", "REF-12345"),
    }
    iban = [r for r in rows if r.rule_id == "iban"]
    assert {r.line_index for r in iban} == {2, 3} and all(r.validation == "checksum" for r in iban)
    assert len([r for r in rows if r.type == "phone"]) == 1 and len([r for r in rows if r.type == "credit_card"]) == 1
    assert len({r.id for r in rows}) == len(rows)
    shown = {r.type for r in scan.scan(lines, K, tool=["email"]).collect()}
    assert "phone" not in shown and {"email", "credit_card"} <= shown


def test_rectangles_cover_what_needs_no_reader(spark):
    lines = pages.lay_out(spark.createDataFrame([(1, "mail a.b@ex.com\nid REF-12345")], "doc_id long, text string"))
    assert [r.type for r in scan.redact(lines, K).collect()] == ["email"]
    assert sorted(r.type for r in scan.redact(lines, K, confirmed=True).collect()) == ["custom_rule", "email"]


def test_boxes_grow_over_the_pieces_of_a_cut_token(spark):
    """A word of three characters or with a digit goes with a token that it stands close to; a word of prose doesn't, nor what stands after it."""
    text = ["use sk_live_abcdefghijklmnopqrstuvwx 9Q 77 here 12", "mail a.b@ex.com 77"]
    lines = pages.lay_out(spark.createDataFrame([(1, "\n".join(text))], "doc_id long, text string"))
    boxes = {r.type: (r.x0, r.x1) for r in scan.scan(lines, K).collect()}
    right = lambda line, word: 10 + 12 * (line.index(word) + len(word))
    assert boxes["api_token"] == (10 + 12 * 4, right(text[0], "77")) and boxes["email"][1] == right(text[1], "ex.com")
