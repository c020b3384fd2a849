"""One query per operator, with production parameters over whole tables, and the SQL that some can be held against."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import dac, language_id, multi_index, nbsvm, packing, prefix_counts, prefix_trie, robust_quality, sentencepiece_codec, sharding, simhash, url_filter, whitening
from maskwright.llm.runtime import Stages, small_batches

TOKENIZERS = os.environ.get("MASKWRIGHT_TOKENIZERS") or os.path.dirname(public_tokenizers.__file__)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: token counts, digest of the ids, whether the text came back, and parity where it was compared."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentencepiece_codec.digest_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return found.select("doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "parity")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document: 3-word shingles, at most 2 differing bits."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = simhash.add_fingerprints(docs, width=3).select("doc_id", "fp")
    found = simhash.near_duplicates(keyed, tau=2)
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def url_captures(pages: DataFrame) -> DataFrame:
    """``pages`` have no fetch time: each page is given a day in two years, by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 37 % 730).cast("int")).alias("fetch_day"))


def url_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: additions, removals, and returns, for hosts, parents and path prefixes."""
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    parts = url_filter.url_parts(pages.select("page_id", "url")).where("host is not null")
    hosts = parts.groupBy("host").agg(F.min("page_id").alias("first"))
    entry = lambda action, n: F.struct(F.lit(action).alias("action"), day(n).alias("day"))
    none = F.array().cast("array<struct<action:string,day:date>>")
    first = F.col("first")
    begun = first * 13 % 500
    steps = F.concat(
        F.when(first % 5 != 4, F.array(entry("add", begun))).otherwise(none),
        F.when(first % 2 == 0, F.array(entry("remove", begun + 90))).otherwise(none),
        F.when(first % 4 == 0, F.array(entry("add", begun + 180))).otherwise(none),
    )
    listed = hosts.select(F.lit("domain").alias("kind"), F.col("host").alias("key"), F.element_at(F.array(*map(F.lit, ["adult", "malware", "spam"])), (first % 3 + 1).cast("int")).alias("category"), F.inline(steps))
    parents = hosts.select(F.regexp_extract("host", r"([^.]+[.][^.]+)$", 1).alias("key")).where("key <> ''").distinct()
    watched = parents.select(F.lit("domain").alias("kind"), "key", F.lit("watch").alias("category"), F.inline(F.array(entry("add", F.lit(600)), entry("remove", F.lit(640)))))
    sections = parts.where("path <> ''").groupBy(F.concat_ws("/", "host", F.split("path", "/")[0]).alias("key")).agg(F.min("page_id").alias("first"))
    sections = sections.where(first % 7 == 0).select(F.lit("prefix").alias("kind"), "key", F.lit("section").alias("category"), F.lit("add").alias("action"), day(first % 300).alias("day"))
    return listed.unionByName(watched).unionByName(sections)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active on its fetch day."""
    pages = _table(spark, sf_dir, "pages")
    found = url_filter.evaluate(url_captures(pages), url_entries(pages))
    return found.select("page_id", "host", "fetch_day", "hits", "categories", "blocked")


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS fetch_day,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '.'), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[1:3] AS segs
  FROM pages),
hosts AS (SELECT host, min(page_id) AS f FROM parts WHERE host IS NOT NULL GROUP BY host),
entries AS (
  SELECT 'domain' AS kind, host AS key, ['adult', 'malware', 'spam'][f % 3 + 1] AS category, s.action, DATE '2023-01-01' + CAST(f * 13 % 500 + s.plus AS INTEGER) AS day
  FROM hosts, (VALUES ('add', 0, 1), ('remove', 90, 2), ('add', 180, 3)) s(action, plus, k)
  WHERE (k = 1 AND f % 5 <> 4) OR (k = 2 AND f % 2 = 0) OR (k = 3 AND f % 4 = 0)
  UNION ALL
  SELECT 'domain', key, 'watch', action, day
  FROM (SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS key FROM hosts), (VALUES ('add', DATE '2023-01-01' + 600), ('remove', DATE '2023-01-01' + 640)) s(action, day)
  WHERE key <> ''
  UNION ALL
  SELECT 'prefix', key, 'section', 'add', DATE '2023-01-01' + CAST(f % 300 AS INTEGER)
  FROM (SELECT host || '/' || segs[1] AS key, min(page_id) AS f FROM parts WHERE host IS NOT NULL AND len(segs) > 0 GROUP BY 1) WHERE f % 7 = 0),
daily AS (SELECT kind, key, category, day, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY kind, key, category ORDER BY day) AS until FROM daily),
wanted AS (
  SELECT page_id, fetch_day, 'domain' AS kind, array_to_string(string_split(host, '.')[i:], '.') AS key
  FROM (SELECT page_id, fetch_day, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM parts WHERE host IS NOT NULL)
  UNION ALL
  SELECT page_id, fetch_day, 'prefix', host || '/' || array_to_string(segs[1:i], '/')
  FROM (SELECT page_id, fetch_day, host, segs, unnest(range(1, len(segs) + 1)) AS i FROM parts WHERE host IS NOT NULL)),
met AS (
  SELECT page_id, count(*) AS hits, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories
  FROM wanted JOIN spans USING (kind, key)
  WHERE action = 'add' AND fetch_day >= day AND (until IS NULL OR fetch_day < until) GROUP BY page_id)
SELECT page_id, host, fetch_day, coalesce(hits, 0) AS hits, coalesce(categories, '') AS categories, hits IS NOT NULL AS blocked
FROM parts LEFT JOIN met USING (page_id)
"""


def op4_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as directly addressable codes on disk, read back: doc_id, start, n_tokens, ids_crc32."""
    path, docs = Stages(spark, "dac").path("corpus"), _table(spark, sf_dir, "documents")
    small_batches(spark, 2048)
    dac.write_corpus(docs, path, f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)
    return dac.read_documents(spark, path)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, base rules and the robust outlier verdict of every document."""
    return robust_quality.judge(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = language_id.add_predictions(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1024 tokens, one row a piece."""
    found = packing.pack_documents(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", end_id=0, keep_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = nbsvm.add_scores(docs, nbsvm.train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8 and its slot there, under the law of equal row counts. Texts are digested before rows move."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("tie"))
    found = sharding.assign(docs, shards=8, tie=F.col("tie"))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors of all embeddings at cosine 0.95."""
    return multi_index.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings on their first 32 components, one row for each vector and component."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)
    by_component = found.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "at"), "n", "deviation", "identity_error")
    return by_component.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "at.whitened", "at.explained", "identity_error")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of rebuilt conversations: c takes the first crc32(c) % 9 turns of conversation c - c % 5."""
    stages = Stages(spark, "prefix-trie")
    turns, runs = prefix_trie.number_turns(_table(spark, sf_dir, "conversations"), stages)
    conv = F.col("conv_id")
    rebuilt = prefix_trie.shared_heads(turns, runs, stages, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, most=8)
    found = prefix_trie.build(*rebuilt, stages)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce("text", '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(unhex(sha256(coalesce(role, ''))) || unhex(sha256(coalesce("text", ''))))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda b: [CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s % 2 = 1 THEN xor(s >> 1, CAST(3988292384 AS BIGINT)) ELSE s >> 1 END), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM t GROUP BY conv_id),
p AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
rebuilt AS (
  SELECT p.conv_id, t.pos AS d, r, x FROM p JOIN t ON t.conv_id = p.base AND t.pos <= p.h
  UNION ALL SELECT p.conv_id, p.taken + t.pos - p.h, r, x FROM p JOIN t ON t.conv_id = p.conv_id AND t.pos > p.h),
k AS (
  SELECT conv_id, d, list({'r': r, 'x': x}) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS key, strlen(x) AS b FROM rebuilt
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(b) AS b FROM k GROUP BY d, key),
m AS (SELECT k.conv_id AS member, k.d, n.conv_id FROM k JOIN n ON k.d = n.d AND k.key = n.key),
tree AS (SELECT n.conv_id, n.d, n.n_convs, n.b, m.conv_id AS parent FROM n LEFT JOIN m ON m.member = n.conv_id AND m.d = n.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY ALL),
full_tree AS (SELECT tree.*, coalesce(n_children, 0) AS n_children FROM tree LEFT JOIN kids USING (conv_id, d)),
sums AS (
  SELECT a.conv_id, a.d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * b) AS saved
  FROM full_tree f JOIN m a ON a.member = f.conv_id AND a.d <= f.d GROUP BY ALL),
ends AS (
  SELECT m.conv_id, m.d, sha256(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member)) AS h
  FROM m JOIN (SELECT member, max(d) AS d FROM m GROUP BY member) USING (member, d) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM full_tree f JOIN sums s USING (conv_id, d) LEFT JOIN ends e USING (conv_id, d)
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, whether they are over 2048, and the longest prefix that isn't."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = prefix_counts.add_prefix_counts(docs, f"{TOKENIZERS}/word_bpe_49k.json", budget=2048, keep=False)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return found.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "kept_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": OP3_SQL, "op12_prefix_trie": OP12_SQL}
