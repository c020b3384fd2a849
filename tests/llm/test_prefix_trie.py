import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from maskwright.llm import prefix_trie, queries

AT = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_dict(convs):
    """The nodes of whole conversations, {conv_id: [(role, text)]}, by dictionaries over all prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = own + sum(saved[k] for k in kids[key])
    ends = {k: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def plain(rows):
    rows = list(rows)
    order = {c: {} for c in {r[0] for r in rows}}
    for conv, turn, role, text in rows:
        leaf = hashlib.sha256(hashlib.sha256((role or "").encode()).digest() + hashlib.sha256((text or "").encode()).digest()).digest()
        order[conv].setdefault((turn is not None, turn or 0, leaf), []).append((role or "", text or ""))
    return {c: [t for key in sorted(found) for t in found[key]] for c, found in order.items() if c is not None}


def got(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def odd_rows():
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", None), (2, 0, "user", "hi"), (2, 1, "bot", ""), (3, None, None, "hi"), (3, 5, "user", "é日"), (None, 0, "user", "lost")]
    rows += [(4, 0, "user", "hi"), (4, 0, "user", "hi"), (5, 2, "userh", "i"), (-7, 0, "user", "hi"), (-7, 1, "bot", ""), (-7, 2, "user", "x" * 100_000)]
    for c in range(10, 40):  # a hot beginning and a group of copies
        rows += [(c, t, "user" if t % 2 else "bot", f"turn {t}" if t < 4 or c < 25 else f"turn {t} {c}") for t in range(7)]
    return rows


@pytest.mark.parametrize("block, levels", [(256, 32), (4, 2), (8, 8), (2, 1)])
def test_trie_equals_dictionaries(spark, block, levels):
    df = spark.createDataFrame([(*r, 9, "x") for r in odd_rows()], "conv_id long, turn long, role string, text string, pos int, digest string").repartition(5)
    assert got(prefix_trie.trie(df, block=block, levels=levels)) == by_dict(plain(odd_rows()))


def test_long_conversations_that_share_a_beginning(spark):
    rows = [(c, t, "user", f"{t}" if t < 60 + 5 * c else f"{t} of {c}") for c in range(4) for t in range(90 + 40 * c)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert got(prefix_trie.trie(df, block=16, levels=4)) == by_dict(plain(rows))


def test_empty_table_has_no_node(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_equals_rebuilt_conversations_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{AT}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own, rebuilt = plain(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    found = got(queries.op12_prefix_trie(spark, AT))
    assert found == by_dict(rebuilt)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{AT}/conversations.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(NAMES)} FROM ({queries.oracle_sql()['op12_prefix_trie']})").fetchall()) == found


def test_query_over_odd_rows(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] is None or r[0] >= 0]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/in/conversations.parquet")
    own = plain(rows)
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    found = got(queries.op12_prefix_trie(spark, f"{tmp_path}/in"))
    assert found == by_dict({c: own.get(c - c % 5, [])[: heads[c]] + own[c][heads[c] :] for c in own})
