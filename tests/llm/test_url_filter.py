import datetime

import duckdb
from pyspark.sql import functions as F

from maskwright.llm import queries, url_filter

DAY = datetime.date(2024, 1, 1)
day = lambda n: DAY + datetime.timedelta(n)


def run(spark, captures, entries):
    c = spark.createDataFrame(captures, "id long, url string, fetch_day date, host string")
    e = spark.createDataFrame(entries, "kind string, key string, category string, action string, day date")
    return {r.id: r for r in url_filter.evaluate(c, e).collect()}, c, e


def test_entries_hold_between_addition_and_removal(spark):
    entries = [("domain", "Bad.example", "x", "add", day(10)), ("domain", "bad.example", "x", "add", day(20)), ("domain", "bad.example", "x", "remove", day(70)), ("domain", "bad.example", "y", "add", day(70)), ("prefix", "ok.example/a/b", "z", "add", day(0)), ("domain", "twice.example", "x", "add", day(5)), ("domain", "twice.example", "x", "remove", day(5)), ("domain", None, "x", "add", day(1))]
    captures = [(1, "http://bad.example/q", day(9), "clash"), (2, "https://u:p@WWW.bad.example.:80/q?x#y", day(10), None), (3, "http://bad.example", day(69), None), (4, "http://bad.example", day(70), None), (5, "http://ok.example/a/b/c?d", day(3), None), (6, "http://ok.example/a", day(3), None), (7, None, day(3), None), (8, "http://bad.example", None, None), (9, "mailto:x", day(3), None), (10, "http://notbad.example", day(30), None), (11, "http://twice.example", day(6), None)]
    captures += [(12, "http://[::1]:80/a", day(3), None), (13, "http://u@[2001:DB8::1]/", day(30), None)]
    entries += [("domain", "[2001:db8::1]", "w", "add", day(0))]
    found, c, e = run(spark, captures, entries)
    assert found[12].host == "[::1]"
    assert {k: r.categories for k, r in found.items() if r.blocked} == {2: "x", 3: "x", 4: "y", 5: "z", 13: "w"}
    assert found[2].host == "www.bad.example" and found[7].host is None and len(found) == 13
    assert url_filter.evaluate(c.limit(0), e).count() == 0
    assert url_filter.evaluate(c, e.limit(0)).where("blocked").count() == 0
    assert url_filter.evaluate(c.union(c), e).where("blocked").count() == 10


def test_prefix_entries_keep_their_path_and_may_be_long(spark):
    entries = [("prefix", "Ok.example/News", "a", "add", day(0)), ("prefix", "ok.example/a/b/c/d/e", "b", "add", day(0)), ("domain", "WWW.x.example", "c", "add", day(0))]
    urls = ["http://OK.example/News/1", "http://ok.example/news/1", "http://ok.example/a/b/c/d/e/f", "http://ok.example/a/b/c/d", "http://www.X.example/"]
    found, _, _ = run(spark, [(i, u, day(3), None) for i, u in enumerate(urls)], entries)
    assert {k: r.categories for k, r in found.items() if r.blocked} == {0: "a", 2: "b", 4: "c"}


def test_only_keys_that_may_be_listed_are_asked_for(spark, monkeypatch):
    """A parent of all hosts, null categories and kinds that nobody asks for; with and without the broadcast of the list's keys."""
    entries = [("domain", "b.com", "x", "add", day(0)), ("domain", "b.com", None, "add", day(2)), ("other", "b.com", "y", "add", day(0)), ("domain", "a.q.b.net", "z", "add", day(1)), ("prefix", "c.com/p", None, "add", day(0))]
    captures = [(1, "http://b.com/", day(1), None), (2, "http://www.b.com/", day(3), None), (3, "http://com/", day(3), None), (4, "http://x.a.q.b.net/", day(3), None), (5, "http://c.com/p/q", day(3), None), (6, "http://c.com", day(3), None)]
    for most in (200_000, 0):
        monkeypatch.setattr(url_filter, "MOST_KEYS", most)
        found, _, _ = run(spark, captures, entries)
        assert {k: (r.hits, r.categories) for k, r in found.items() if r.blocked} == {1: (1, "x"), 2: (2, "x"), 4: (1, "z"), 5: (1, "")}
    levels = url_filter.key_levels(url_filter.intervals(spark.createDataFrame(entries, "kind string, key string, category string, action string, day date")))
    assert levels["domain"] == [2, 4] and levels["prefix"] == [1]
    asked = spark.createDataFrame([("www.b.com", "p/q")], "host string, path string").select(F.inline(url_filter.candidate_keys(levels))).collect()
    assert sorted(r.key for r in asked) == ["b.com", "www.b.com/p"]


def test_query_matches_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet'")
    got = queries.op3_url_filters(spark, at).orderBy("page_id").select(sorted(["page_id", "host", "fetch_day", "hits", "categories", "blocked"])).collect()
    want = con.sql(f"SELECT blocked, categories, fetch_day, hits, host, page_id FROM ({queries.OP3_SQL}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in got] == want and any(r.blocked for r in got)


def test_no_python_in_plan(spark):
    plan = queries.op3_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
