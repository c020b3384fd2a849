"""Queries over texts that are made from keys, so that SQL can state what has to be found: detectors, normalisers, validators, boxes.

The makers are SQL that Spark and DuckDB read alike; what is expected is stated apart, in DuckDB's SQL alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import checks, detectors, fixed
from maskwright.functions import text as T
from maskwright.operators import boxes, masking, pages, review, scan, spatial, words
from maskwright.plans.catalog import line_boxes
from maskwright.sources.tables import dealt, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(make):
        QUERIES[make.__name__], SQL[make.__name__] = make, sql
        return make

    return add


def _made(spark: SparkSession, keys: DataFrame, sql: str) -> DataFrame:
    """``sql`` over ``keys`` as table orders, under a name that stays in the session only while the plan is made."""
    keys.createOrReplaceTempView("maskwright_keys")
    rows = spark.sql(sql.replace("FROM orders", "FROM maskwright_keys"))
    spark.catalog.dropTempView("maskwright_keys")
    return rows


# Letters that no number pattern reads as digits.
_KEYS = "SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS STRING), 8, '0') AS d, translate(md5(CAST(o_orderkey AS STRING)), '0123456789bl', 'ghijkmnpqrtu') AS h FROM orders"
_N = lambda i, of="n": f"CAST(substr({of}, {i}, 1) AS INT)"
_ODD, _EVEN = " + ".join(map(_N, (1, 3, 5, 7, 9))), " + ".join(map(_N, (2, 4, 6, 8)))
_TCKN = f"""SELECT k, d, h, concat(n, CAST(t AS STRING), CAST((({_ODD}) + ({_EVEN}) + t) % 10 AS STRING)) AS tckn FROM
(SELECT k, d, h, n, ((({_ODD}) * 7 - ({_EVEN})) % 10 + 10) % 10 AS t FROM (SELECT k, d, h, concat('1', d) AS n FROM ({_KEYS}) a) b) c"""

# What is planted (Spark and DuckDB), and what is to be found there (DuckDB): type, text, place, for review.
_PLANTS = {
    "email": ("concat('write to u', CAST(k AS STRING), '@mail.example.com today')", "'u' || k || '@mail.example.com'", "9", "FALSE"),
    "ipv4": ("concat('from 10.', CAST(k % 256 AS STRING), '.', CAST(k % 199 AS STRING), ' . 7:8080 ok')", "'10.' || k % 256 || '.' || k % 199 || '.7:8080'", "5", "FALSE"),
    "ipv6": ("concat('at 2001:db8::', CAST(k % 9000 + 1000 AS STRING), ' up')", "'2001:db8::' || (k % 9000 + 1000)", "3", "FALSE"),
    "tckn": ("concat('no ', tckn, ' given')", "tckn", "3", "FALSE"),
    "vkn": ("concat('vergi no ', '12', d)", "'12' || d", "9", "FALSE"),
    "ssn": ("concat('ssn: 123-45-', CAST(k % 9000 + 1000 AS STRING))", "'123-45-' || (k % 9000 + 1000)", "5", "FALSE"),
    "custom_rule": ("concat('pay DE', lpad(CAST(98 - (k * 1000000 + 131400) % 97 AS STRING), 2, '0'), lpad(CAST(k AS STRING), 18, '0'), ' now')", "'DE' || lpad(CAST(98 - (k * 1000000 + 131400) % 97 AS VARCHAR), 2, '0') || lpad(CAST(k AS VARCHAR), 18, '0')", "4", "FALSE"),
    "bearer_token": ("concat('Authorization: Bearer tok', h)", "'Bearer tok' || h", "15", "FALSE"),
    "passport": ("concat('Passport No: ab', substr(d, 3, 6))", "'AB' || d[3:8]", "13", "FALSE"),
    "session_id": ("concat('(sess_', substr(h, 1, 12), ')')", "'sess_' || h[1:12]", "1", "FALSE"),
    "person_name": ("concat('Customer name: Maya ', CASE WHEN k % 2 = 0 THEN 'Stone' ELSE 'Rivers' END)", "'Maya ' || CASE WHEN k % 2 = 0 THEN 'Stone' ELSE 'Rivers' END", "15", "FALSE"),
    "location": ("concat('City: ', CASE WHEN k % 2 = 0 THEN 'Lakeside' ELSE 'Hill End' END)", "CASE WHEN k % 2 = 0 THEN 'Lakeside' ELSE 'Hill End' END", "6", "FALSE"),
    "api_token": ("concat('use sk_live_', substr(h, 1, 26), ' here')", "'sk_live_' || h[1:26]", "4", "FALSE"),
    "private_key": ("concat('-----BEGIN RSA PRIVATE KEY----- ', h, ' -----END RSA PRIVATE KEY----- .')", "'-----BEGIN RSA PRIVATE KEY----- ' || h || ' -----END RSA PRIVATE KEY-----'", "0", "FALSE"),
    "id": ("concat('see REF-', d)", "'REF-' || d", "4", "TRUE"),
    "phone": ("concat('call +90 532 ', substr(d, 2, 3), ' ', substr(d, 5, 2), ' ', substr(d, 7, 2), '.')", "'+90 532 ' || d[2:4] || ' ' || d[5:6] || ' ' || d[7:8]", "5", "FALSE"),
    "env_secret": ("concat('API_TOKEN=\"', substr(h, 1, 14), '\"')", "h[1:14]", "11", "FALSE"),
    "seed": ("'nothing to be found here'", "NULL", "NULL", "NULL"),
}
_PLANTED = f"SELECT k, CASE {' '.join(f'WHEN k % {len(_PLANTS)} = {i} THEN {make}' for i, (make, *_) in enumerate(_PLANTS.values()))} END AS text FROM ({_TCKN}) t"
_WANTED = f"""WITH t AS ({_TCKN}), w AS (SELECT k, unnest([{', '.join(f"struct_pack(i := {i}, type := '{dict(id='custom_rule').get(kind, kind)}', hit := {text}, start := {start}, needs_review := {review})" for i, (kind, (_, text, start, review)) in enumerate(_PLANTS.items()))}]) AS s FROM t)
SELECT k, s.type AS type, s.hit AS text, CAST(s.start AS INTEGER) AS start, s.needs_review AS needs_review FROM w WHERE s.i = k % {len(_PLANTS)} AND s.hit IS NOT NULL"""


@query(_WANTED)
def planted_detections(spark, sf_dir):
    """A value of every type, made from a key, and nothing else found beside it."""
    rows = _made(spark, table(spark, sf_dir, "orders"), _PLANTED)
    return review.add_review(detectors.detect(rows, ["k"])).where("listed").select("k", "type", "text", "start", "needs_review")


@query(f"""WITH t AS ({_KEYS})
SELECT k, 'a' || d || ' b c' AS sanitized, h[1:5] || ' 0 5 end' AS trunk, upper('de' || d || 'x') AS iban, 'sk_live_' || h[1:24] AS token, 'api_test_' || h[1:10] AS api, 'musteriadi' || d AS label, 'maya' || d AS name_key,
  'u' || k || CASE k % 3 WHEN 0 THEN '@x.com' WHEN 1 THEN '@x.org' ELSE '@x.qqq' END AS email, upper(h[1:1]) || h[2:6] AS bare_name, CAST(CASE WHEN k % 2 = 0 THEN 11 ELSE 6 END AS INTEGER) AS extended FROM t""")
def planted_normalisers(spark, sf_dir):
    """Normalisers over values made from keys."""
    rows, c = _made(spark, table(spark, sf_dir, "orders"), _KEYS), F.col
    email = F.concat(F.lit("u"), c("k").cast("string"), F.when(c("k") % 3 == 0, "@x.comhello").when(c("k") % 3 == 1, "@x.orgzz").otherwise("@x.qqq"))
    name = F.concat(F.upper(F.substring("h", 1, 1)), F.substring("h", 2, 5))
    line = F.concat(F.lit("see "), name, F.when(c("k") % 2 == 0, "'ndan it").otherwise("'xyz it"))
    return rows.select(
        "k",
        T.sanitize_text(F.concat(F.lit(" a"), "d", F.lit(".,  b;\t c! "))).alias("sanitized"),
        T.rewrite_trunk_o(F.concat(F.substring("h", 1, 5), F.lit(" O 5 end"))).alias("trunk"),
        T.compact_iban(F.concat(F.lit("d e - "), F.substring("d", 1, 4), F.lit(" "), F.substring("d", 5, 4), F.lit("-x"))).alias("iban"),
        T.format_api_token(F.concat(F.lit("SKlive"), F.substring("h", 1, 24))).alias("token"),
        T.format_api_token(F.concat(F.lit("apiTEST"), F.substring("h", 1, 10))).alias("api"),
        T.label_text(F.concat(F.lit("Musterı Adı: "), "d")).alias("label"),
        T.name_key(F.concat(F.lit("Maya'nın "), "d")).alias("name_key"),
        T.trim_email_tld(email).alias("email"),
        T.strip_name_suffix(F.concat(name, F.lit("'ndan"))).alias("bare_name"),
        T.extend_name_suffix(line, F.lit(4), F.lit(6)).cast("int").alias("extended"),
    )


@query(f"""WITH t AS ({_KEYS})
SELECT k, CASE k % 4 WHEN 0 THEN '11-digit,first-digit-nonzero' WHEN 1 THEN '11-digit' WHEN 2 THEN '11-digit,first-digit-nonzero,checksum-valid' ELSE 'first-digit-nonzero' END AS evidence,
  k % 3 <> 2 AS phone, k % 3 = 0 AS carrier, k % 4 < 2 AS ipv6_body, k % 4 < 3 AS ipv6, k % 4 <> 3 AS fragment, k % 2 = 0 AS log_name, k % 3 = 0 AS token, k % 3 <> 0 AS truncated,
  k % 2 = 0 AS public_pem, k % 2 = 1 AS broken_header, k % 3 <> 0 AS base64, k % 2 = 0 AS glyph_line FROM t""")
def planted_checks(spark, sf_dir):
    """Validators over values made from keys: each key's rest decides which answer is due. What is to be no token begins like none, whatever its digest."""
    rows, k, c = _made(spark, table(spark, sf_dir, "orders"), _KEYS), F.col("k"), F.col
    pick = lambda n, *values: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (k % n + 1).cast("int"))
    hexed = F.lower(F.hex(k % 60000 + 1))
    body = pick(4, F.concat(F.lit("2001:db8::"), hexed), F.concat(F.lit("1:2:3:4:5:6:7:"), hexed), F.concat(F.lit("[2001:db8::1]:"), (k % 60000 + 1).cast("string")), F.concat(F.lit("1:2:"), hexed, F.lit(":g")))
    return rows.select(
        "k",
        F.array_join(checks.tckn_evidence(pick(4, "1OOOO0000l0", "01234567890", "10000000146", "123")), ",").alias("evidence"),
        checks.phone_shape(pick(3, F.concat(F.lit("+90 532 "), F.substring("d", 2, 7)), F.concat(F.lit("+1 (415) "), F.substring("d", 2, 7)), "12-34")).alias("phone"),
        checks.turkish_carrier(pick(3, F.concat(F.lit("+90 532 "), F.substring("d", 2, 7)), F.concat(F.lit("+90 932 "), F.substring("d", 2, 7)), F.lit("0555"))).alias("carrier"),
        checks.ipv6_body(body).alias("ipv6_body"),
        checks.ipv6(body).alias("ipv6"),
        checks.ipv6_fragment(pick(4, "2001", "db8::", ":1", "xyz")).alias("fragment"),
        checks.log_identifier(pick(2, F.concat(F.lit("user_profile_"), F.substring("h", 1, 8)), F.concat(F.lit("ab_"), F.substring("h", 1, 8)))).alias("log_name"),
        checks.api_token(pick(3, F.concat(F.lit("ghp_"), "h"), F.lit("short"), F.concat(F.lit("x"), F.substring("h", 1, 8), F.lit(" "), F.substring("h", 1, 12)))).alias("token"),
        checks.truncated_credential(pick(3, F.concat(F.lit("sk_live_"), F.substring("h", 1, 24)), F.concat(F.lit("sk_live_"), F.substring("h", 1, 10)), F.concat(F.lit("ghp_"), F.substring("h", 1, 10)))).alias("truncated"),
        checks.public_pem(pick(2, "-----BEGIN PUBLIC KEY-----", "-----BEGIN RSA PRIVATE KEY-----")).alias("public_pem"),
        checks.broken_key_header(pick(2, "-- BEGIN PUBLIC KEY", "-- BEG1N RSA PR1VATE KEY")).alias("broken_header"),
        checks.base64_line(pick(3, F.substring("h", 1, 12), F.col("h"), F.concat(F.lit(" "), "h", F.lit("== ")))).alias("base64"),
        checks.tckn(T.correct_digits(pick(2, "IOOOOOOOI46", "IOOOOOOOI47"))).alias("glyph_line"),
    )


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 14 AS pos FROM customer), w AS (SELECT list_transform(range(1, 27), lambda i: 'word' || chr(CAST(96 + i AS INTEGER))) AS ws)
SELECT k, CAST(i AS INTEGER) AS line_index, array_to_string(ws[pos + 1:pos + 12], ' ') AS text, CASE i WHEN 0 THEN array_to_string(ws[pos + 1:pos + 7], ' ') ELSE array_to_string(ws[pos + 8:pos + 12], ' ') END AS span FROM c, w, (VALUES (0), (1)) v(i) WHERE k % 3 = 0
UNION ALL SELECT k, 0, array_to_string(ws[pos + 1:pos + 12], ' '), array_to_string(ws[pos + 1:pos + 12], ' ') FROM c, w WHERE k % 3 = 1""")
def planted_seed_phrases(spark, sf_dir):
    """Seed phrases in one line, over two lines, and one word short."""
    names = [f"word{chr(97 + i)}" for i in range(26)]
    listed = F.array(*map(F.lit, names))
    k, at = F.col("c_custkey"), (F.col("c_custkey") % 14).cast("int")
    part = lambda a, n: F.array_join(F.slice(listed, at + a, F.lit(n)), " ")
    text = F.when(k % 3 == 0, F.concat(F.lit("x "), part(1, 7), F.lit("\n"), part(8, 5), F.lit(" y"))).when(k % 3 == 1, F.concat(F.lit("x "), part(1, 12))).otherwise(F.concat(part(1, 11), F.lit(" end")))
    customers = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", grows=64)
    lines = pages.lay_out(customers.select(k.alias("doc_id"), text.alias("text")))
    found = pages.seed_phrase_lines(lines, ["doc_id", "page"], spark.createDataFrame([(w,) for w in names], "word string"))
    return found.select(F.col("doc_id").alias("k"), "line_index", "text", "span")


_LINE_BOXES = f"""boxes AS (SELECT l_orderkey AS page, l_linenumber AS id, {["phone", "email", "person_name", "session_id", "custom_rule", "location", "ipv4"]}[(l_partkey + l_linenumber) % 7 + 1] AS type, 'v' || l_partkey % 5 AS text,
  CAST(l_partkey % 60 AS DOUBLE) AS x0, CAST(l_suppkey % 12 AS DOUBLE) AS y0, CAST(l_partkey % 60 AS DOUBLE) + 10 + l_quantity AS x1, CAST(l_suppkey % 12 AS DOUBLE) + 12 AS y1 FROM lineitem)"""


# One item after another of each page and type, largest first; those like a kept one go.
@query(f"""WITH RECURSIVE {_LINE_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page, type ORDER BY -((x1 - x0) * (y1 - y0)), id, text, x0, y0) AS n FROM boxes),
step AS (SELECT page, type, n, [struct_pack(id := id, text := text, x0 := x0, y0 := y0, x1 := x1, y1 := y1)] AS kept FROM o WHERE n = 1
  UNION ALL
  SELECT o.page, o.type, o.n, CASE WHEN len(list_filter(kept, lambda b:
      (NOT (abs((b.y0 + b.y1) / 2 - (o.y0 + o.y1) / 2) > 10 AND least(b.y1, o.y1) - greatest(b.y0, o.y0) < greatest(least(b.y1 - b.y0, o.y1 - o.y0), 1) * 0.5)
       AND (2 * greatest(least(b.x1, o.x1) - greatest(b.x0, o.x0), 0) * greatest(least(b.y1, o.y1) - greatest(b.y0, o.y0), 0) > (b.x1 - b.x0) * (b.y1 - b.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(least(b.x1, o.x1) - greatest(b.x0, o.x0), 0) * greatest(least(b.y1, o.y1) - greatest(b.y0, o.y0), 0)
         OR sqrt(((b.x0 + b.x1) / 2 - (o.x0 + o.x1) / 2) ** 2 + ((b.y0 + b.y1) / 2 - (o.y0 + o.y1) / 2) ** 2) < 20))
      OR (o.type = 'person_name' AND b.text = o.text AND abs((b.y0 + b.y1) / 2 - (o.y0 + o.y1) / 2) <= 12 * 0.65 AND greatest(b.x0, o.x0) - least(b.x1, o.x1) <= 12 * 1.25))) > 0
    THEN kept ELSE list_append(kept, struct_pack(id := o.id, text := o.text, x0 := o.x0, y0 := o.y0, x1 := o.x1, y1 := o.y1)) END
  FROM step s JOIN o ON o.page = s.page AND o.type = s.type AND o.n = s.n + 1),
last AS (SELECT page, type, arg_max(kept, n) AS kept FROM step GROUP BY page, type)
SELECT page, type, unnest(kept).id AS id FROM last""")
def deduplicated_boxes(spark, sf_dir):
    """Greedy removal of repeats by place, by page and type."""
    return spatial.deduplicate(line_boxes(spark, sf_dir), ["page"]).select("page", "type", "id")


@query(f"""WITH {_LINE_BOXES}, n AS (SELECT *, x0 - 2 AS a, y0 - 2 AS b, x1 + 2 AS c, y1 + 2 AS d FROM boxes)
SELECT page, id, round(a / 200, 9) AS norm_x, round(b / 80, 9) AS norm_y, round((c - a) / 200, 9) AS norm_width, round((d - b) / 80, 9) AS norm_height, round(a / 200 * 50, 6) AS x, round(b / 80 * 40, 6) AS y, round((c - a) / 200 * 50, 6) AS w, round((d - b) / 80 * 40, 6) AS h FROM n""")
def normalized_boxes(spark, sf_dir):
    """Padded boxes as shares of the page and on a smaller canvas."""
    rows = boxes.padded(line_boxes(spark, sf_dir)).withColumns({"width": F.lit(200), "height": F.lit(80), "cw": F.lit(50), "ch": F.lit(40)})
    made = boxes.mapped(boxes.normalized(rows), "cw", "ch")
    return made.select("page", "id", *[F.round(c, 9).alias(c) for c in ("norm_x", "norm_y", "norm_width", "norm_height")], *[F.round(c, 6).alias(c) for c in "xywh"])


@query(f"WITH {_LINE_BOXES} SELECT a.page, a.id, count(*) AS n FROM boxes a JOIN boxes b ON a.page = b.page AND NOT (a.x1 < b.x0 OR a.x0 > b.x1 OR a.y1 < b.y0 OR a.y0 > b.y1) AND b.type = 'email' GROUP BY a.page, a.id")
def touching_boxes(spark, sf_dir):
    """How many e-mail boxes of its page each box touches."""
    rows = line_boxes(spark, sf_dir)
    return boxes.touching(rows, rows.where("type = 'email'").select("page", "x0", "y0", "x1", "y1"), ["page"]).groupBy("page", "id").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_partkey % 90 AS DOUBLE) AS x, CAST(l_suppkey % 70 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)
SELECT k, n, round(2 * x, 6) AS x0, round((800 - 2 * y) - 24 * 0.94, 6) AS y0, round(2 * x + q * 2, 6) AS x1, round((800 - 2 * y) - 24 * 0.94 + 24 * 1.28, 6) AS y1 FROM t""")
def item_boxes(spark, sf_dir):
    """Boxes of positioned text items on a viewport of twice the size, upside down."""
    x, y = (F.col("l_partkey") % 90).cast("double"), (F.col("l_suppkey") % 70).cast("double")
    flat = [F.lit(v) for v in (12.0, 0.0, 0.0, 12.0)]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.array(*flat, x, y).alias("transform"), F.col("l_quantity").cast("double").alias("width"))
    return boxes.item_boxes(rows, [2.0, 0.0, 0.0, -2.0, 0.0, 800.0]).select("k", "n", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_NESTED = """l AS (SELECT item_id, CAST(i - 1 AS INTEGER) AS line, parts[i] AS t FROM (SELECT item_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM benchmark)),
w AS (SELECT item_id, line, CAST(k - 1 AS INTEGER) AS word, ws[k] AS raw FROM (SELECT item_id, line, string_split(t, ' ') AS ws, unnest(range(1, len(string_split(t, ' ')) + 1)) AS k FROM l))"""


def _nested(spark, sf_dir):
    """Recognition results made of the benchmark's lines: one block with one paragraph, boxes at twice the size."""
    box = lambda x0, x1, y: F.struct(x0.cast("double").alias("x0"), y.cast("double").alias("y0"), x1.cast("double").alias("x1"), (y + 30).cast("double").alias("y1"))
    words = lambda t, y: F.transform(F.split(t, " "), lambda w, j: F.struct(w.alias("text"), (j * 40).cast("double").alias("confidence"), box(j * 100, j * 100 + F.length(w) * 10, y).alias("box")))
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("text"), F.lit(55.0).alias("confidence"), box(F.lit(0), F.length(t) * 10, i * 40).alias("box"), words(t, i * 40).alias("words")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array(F.struct(F.array(F.struct(lines.alias("lines"))).alias("paragraphs"))).alias("blocks"))


@query(f"""WITH {_NESTED}, s AS (SELECT *, regexp_replace(trim(raw), '[.,;:!]+$', '') AS text FROM w)
SELECT item_id, '0-0-' || line AS line_id, word, text, least(word * 40.0, 100.0)::DOUBLE AS confidence, (word * 50)::DOUBLE AS x0, (line * 20)::DOUBLE AS y0, (word * 50 + length(raw) * 5)::DOUBLE AS x1, (line * 20 + 15)::DOUBLE AS y1 FROM s WHERE text <> ''""")
def recognised_words(spark, sf_dir):
    return boxes.recognised_words(_nested(spark, sf_dir), ["item_id"], 2.0).select("item_id", "line_id", "word", "text", "confidence", "x0", "y0", "x1", "y1")


@query(f"""WITH {_NESTED}, m AS (SELECT item_id, line, avg(least(word * 40.0, 100.0)) AS mean FROM w WHERE regexp_replace(trim(raw), '[.,;:!]+$', '') <> '' GROUP BY 1, 2)
SELECT l.item_id, '0-0-' || l.line AS line_id, trim(regexp_replace(t, '[ \\t]+', ' ', 'g')) AS text, round(coalesce(mean, 55), 6) AS confidence, (length(t) * 5)::DOUBLE AS x1, (l.line * 20)::DOUBLE AS y0 FROM l LEFT JOIN m USING (item_id, line) WHERE trim(t) <> ''""")
def recognised_lines(spark, sf_dir):
    return boxes.recognised_lines(_nested(spark, sf_dir), ["item_id"], 2.0).select("item_id", "line_id", "text", F.round("confidence", 6).alias("confidence"), "x1", "y0")


@query("""SELECT k, '2001:db8::' || (k % 9000 + 1000) AS text, 10 + 4 * 12 AS x0 FROM (SELECT o_orderkey AS k FROM orders)""")
def address_pieces(spark, sf_dir):
    """Addresses put together from three scanned pieces."""
    text = F.concat(F.lit("see 2001 db8:: "), (F.col("o_orderkey") % 9000 + 1000).cast("string"))
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", grows=8)
    words = pages.words_of(pages.lay_out(orders.select("o_orderkey", text.alias("text")), "o_orderkey"), ["doc_id", "page"])
    return pages.fragments(words, ["doc_id", "page"]).select(F.col("doc_id").alias("k"), "text", F.col("x0").cast("int").alias("x0"))


@query("""SELECT k, CAST(i AS INTEGER) AS line_index, CASE i WHEN 0 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 3 THEN '-----END RSA PRIVATE KEY-----' ELSE 'MII' || repeat('ab', 15) || k END AS span, CAST(CASE i WHEN 0 THEN 4 ELSE 0 END AS INTEGER) AS start
FROM (SELECT c_custkey AS k FROM customer), (VALUES (0), (1), (2), (3)) v(i)""")
def keys_over_lines(spark, sf_dir):
    """Private keys over four lines, between other lines."""
    body = F.concat(F.lit("MII" + "ab" * 15), F.col("c_custkey").cast("string"))
    text = F.concat_ws("\n", F.lit("see -----BEGIN RSA PRIVATE KEY-----"), body, body, F.lit("-----END RSA PRIVATE KEY----- end"), F.lit("after"))
    lines = pages.lay_out(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey")
    return pages.private_keys(lines, ["doc_id", "page"]).select(F.col("doc_id").alias("k"), "line_index", "span", "start")


_LENGTH = "length(w.text) + CASE WHEN w.type = 'ipv4' THEN 2 ELSE 0 END"


def _planted_pages(spark, sf_dir):
    return pages.lay_out(_made(spark, table(spark, sf_dir, "orders"), _PLANTED), "k")


@query(f"""WITH p AS ({_PLANTED}), w AS (SELECT * FROM ({_WANTED}) WHERE NOT needs_review)
SELECT p.k, CASE WHEN w.k IS NULL THEN p.text ELSE p.text[1:w.start] || repeat('█', {_LENGTH}) || p.text[w.start + {_LENGTH} + 1:] END AS masked, CAST(0 AS INTEGER) AS n_leaks FROM p LEFT JOIN w ON p.k = w.k""")
def planted_masking(spark, sf_dir):
    """Texts with what may be covered unseen covered, and values that can still be read."""
    rows = _made(spark, table(spark, sf_dir, "orders"), _PLANTED)
    found = written(review.automatic(review.add_review(detectors.detect(rows, ["k"]))).select("k", "start", "span"), "found")
    masked = masking.cover_pages(rows, found, ["k"], ["k"], keep_terms=True)
    left = F.size(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: masking.uncovered(F.col("text"), F.col("masked"), t)))
    return masked.select("k", "masked", left.alias("n_leaks"))


@query(f"""WITH p AS ({_PLANTED}), w AS ({_WANTED}), m AS (SELECT p.k, p.text AS line, w.type, w.start, {_LENGTH} AS n FROM p JOIN w ON p.k = w.k)
SELECT k, type, 10.0::DOUBLE + 12 * (start - length(regexp_extract(line[1:start], '(\\S*)$', 1))) AS x0, 10.0::DOUBLE + 12 * (start + n + length(regexp_extract(line[start + n + 1:], '^(\\S*)', 1))) AS x1, 20.0::DOUBLE AS y0, 36.0::DOUBLE AS y1 FROM m""")
def planted_places(spark, sf_dir):
    """Boxes of the words that each match touches."""
    lines = _planted_pages(spark, sf_dir).withColumn("line", F.col("text"))
    found = pages.detect_lines(lines, ["doc_id", "page"], carry=("line", "x0", "y0", "x1", "y1"))
    return pages.place_on_line(found.where("listed"), "line").select(F.col("doc_id").alias("k"), "type", *[F.round(c, 6).alias(c) for c in ("x0", "x1", "y0", "y1")])


_IBAN = "'DE' || lpad(CAST(98 - (k * 1000000 + 131400) % 97 AS VARCHAR), 2, '0')"


@query(f"""WITH t AS ({_TCKN}), b AS (SELECT *, lpad(CAST(k AS VARCHAR), 18, '0') AS n FROM t)
SELECT k, CASE k % 3 WHEN 0 THEN 'tckn' WHEN 1 THEN 'custom_rule' ELSE 'email' END AS type, CAST(1 AS INTEGER) AS first_word, CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 3 END AS INTEGER) AS n_words,
  CASE k % 3 WHEN 0 THEN tckn WHEN 1 THEN {_IBAN} || ' ' || n[1:4] || ' ' || n[5:8] || ' ' || n[9:12] || ' ' || n[13:16] || ' ' || n[17:18] ELSE 'u' || k || '@mail.example.com' END AS text FROM b""")
def planted_groups(spark, sf_dir):
    """Values that a scanner cut into words."""
    rows, k, t = _made(spark, table(spark, sf_dir, "orders"), _TCKN), F.col("k"), F.col("tckn")
    n, cut = F.lpad(k.cast("string"), 18, "0"), lambda c, a, z: F.substring(c, a, z)
    iban = F.concat_ws(" ", F.concat(F.lit("DE"), F.lpad((98 - (k * 1000000 + 131400) % 97).cast("string"), 2, "0")), *[cut(n, a, 4) for a in (1, 5, 9, 13)], cut(n, 17, 2))
    text = F.when(k % 3 == 0, F.concat_ws(" ", F.lit("no"), cut(t, 1, 3), cut(t, 4, 4), cut(t, 8, 4), F.lit("end"))).when(k % 3 == 1, F.concat(F.lit("pay: "), iban, F.lit(" now."))).otherwise(F.concat(F.lit("see: u"), k.cast("string"), F.lit("@mail .example .com")))
    found = words.grouped_secrets(pages.words_of(pages.lay_out(rows.select("k", text.alias("text")), "k"), ["doc_id", "page"]), ["doc_id", "page"])
    return found.select(F.col("doc_id").alias("k"), "type", "first_word", "n_words", "text")


@query(f"WITH t AS ({_KEYS}) SELECT k, CASE WHEN k % 2 = 1 THEN '0' ELSE '+90' END || ' 532 ' || d[2:4] || ' ' || d[5:6] || ' ' || d[7:8] AS text, CAST(0 AS BIGINT) AS row, 58.0::DOUBLE AS x0, CASE WHEN k % 2 = 1 THEN 238.0 ELSE 262.0 END::DOUBLE AS x1, k % 2 = 1 AS ocr_corrected FROM t")
def planted_row_phones(spark, sf_dir):
    """Phone numbers over the words of a row, a lone letter O read as a zero."""
    number = F.concat(F.lit("tel "), F.when(F.col("k") % 2 == 1, "O").otherwise("+90"), F.lit(" 532 "), F.substring("d", 2, 3), F.lit(" "), F.substring("d", 5, 2), F.lit(" "), F.substring("d", 7, 2))
    lines = pages.lay_out(_made(spark, table(spark, sf_dir, "orders"), _KEYS).select("k", number.alias("text")), "k")
    found = words.phones_in_rows(pages.words_of(lines, ["doc_id", "page"]), ["doc_id", "page"])
    return found.select(F.col("doc_id").alias("k"), "text", F.col("row").cast("long").alias("row"), F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"), "ocr_corrected")


@query(f"""WITH t AS ({_KEYS}), b AS (SELECT *, lpad(CAST(k AS VARCHAR), 18, '0') AS n FROM t)
SELECT k, 'iban' AS what, CAST(0 AS INTEGER) AS line_index, {_IBAN} || n AS text FROM b WHERE k % 2 = 0
UNION ALL SELECT k, 'bearer', CAST(i AS INTEGER), 'Bearer ' || h[1:24] FROM b, (VALUES (0), (1)) v(i) WHERE k % 2 = 1""")
def planted_wraps(spark, sf_dir):
    """Account numbers and bearer tokens that go on in the next line."""
    rows, k, n = _made(spark, table(spark, sf_dir, "orders"), _KEYS), F.col("k"), F.lpad(F.col("k").cast("string"), 18, "0")
    iban = F.concat(F.lit("pay DE"), F.lpad((98 - (k * 1000000 + 131400) % 97).cast("string"), 2, "0"), F.lit(" "), F.substring(n, 1, 4), F.lit(" "), F.substring(n, 5, 4), F.lit("\n"), F.substring(n, 9, 4), F.lit(" "), F.substring(n, 13, 6), F.lit(" soon"))
    bearer = F.concat(F.lit("Authorization: Bearer "), F.substring("h", 1, 8), F.lit("\n"), F.substring("h", 9, 16))
    lines = pages.lay_out(rows.select("k", F.when(k % 2 == 0, iban).otherwise(bearer).alias("text")), "k")
    keys = ["doc_id", "page"]
    ibans = pages.wrapped_ibans(lines, keys).select(F.col("doc_id").alias("k"), F.lit("iban").alias("what"), "line_index", F.col("compact").alias("text"))
    return ibans.unionByName(pages.wrapped_bearer_tokens(lines, keys).select(F.col("doc_id").alias("k"), F.lit("bearer").alias("what"), "line_index", "text"))


@query(f"""WITH t AS ({_TCKN}) SELECT k, 'session_id' AS type, 'sess_' || h[1:12] AS text FROM t WHERE k % 3 = 0
UNION ALL SELECT k, 'api_token', 'api_test_' || h[1:12] FROM t WHERE k % 3 = 1 UNION ALL SELECT k, 'second', tckn FROM t WHERE k % 3 = 2""")
def planted_readings(spark, sf_dir):
    """Values beside their labels, in pieces, and numbers with a digit too many in a second reading."""
    rows, k = _made(spark, table(spark, sf_dir, "orders"), _TCKN), F.col("k")
    half = lambda a, b: F.substring("h", a, b)
    text = F.when(k % 3 == 0, F.concat(F.lit("Session ID: sess_"), half(1, 5), F.lit(" "), half(6, 7))).otherwise(F.concat(F.lit("API token: api_test_"), half(1, 5), F.lit(" "), half(6, 7)))
    every = pages.words_of(pages.lay_out(rows.where(k % 3 < 2).select("k", text.alias("text")), "k"), ["doc_id", "page"])
    beside = words.values_beside_labels(every, ["doc_id", "page"]).select(F.col("doc_id").alias("k"), "type", "text")
    second = words.second_pass_numbers(rows.where(k % 3 == 2).select("k", F.concat(F.lit("0"), "tckn").alias("text")), ["k"])
    return beside.unionByName(second.select("k", F.lit("second").alias("type"), "text"))


@query(f"WITH {_LINE_BOXES} SELECT page, id, 'visual-' || CAST(round((y0 + y1) / 2 / greatest(6, greatest(y1 - y0, 1) * 0.6)) AS BIGINT) AS visual_key FROM boxes WHERE page % 3 > 0")
def visual_lines(spark, sf_dir):
    """Buckets of boxes without a line, on pages with a number of 1 and more."""
    rows = line_boxes(spark, sf_dir)
    numbered = boxes.pages_of(rows.withColumn("n", F.when(F.col("page") % 3 == 0, "x").otherwise((F.col("page") % 3).cast("string"))), "n")
    return pages.visual_line(numbered).select("page", "id", "visual_key")


@query(f"""SELECT k, type, text, CAST(0 AS INTEGER) AS line_index FROM ({_WANTED.replace('FROM orders', 'FROM (SELECT c_custkey AS o_orderkey FROM customer)')})""")
def planted_scan(spark, sf_dir):
    """The whole scan over planted pages: every source, policy, repeats and shadows removed."""
    keyed = table(spark, sf_dir, "customer").selectExpr("c_custkey as o_orderkey")
    found = scan.scan(pages.lay_out(_made(spark, keyed, _PLANTED), "k"), ["doc_id", "page"])
    return found.select(F.col("doc_id").alias("k"), "type", "text", "line_index")
