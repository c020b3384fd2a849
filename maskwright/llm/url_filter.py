"""URL filters by a temporal list join, in DataFrame operations alone.

A list is a table of dated entries: kind (``domain``: the host or any parent of it; ``prefix``: host and leading path
segments), key, category, action (``add`` or ``remove``) and day. Entries become validity intervals: an addition holds
from its day to the day before the key's next entry in that category. Each capture is evaluated as of its fetch day.

The as-of join is an equi-join on (kind, key) with the interval as residual condition. Captures are reduced to
distinct (host, path, day) first, so a host with a third of all pages joins once for each of its paths and days. A capture asks only for
keys of lengths that some entry has, and, where the list's keys are few enough to broadcast, only for those that are listed: a
top-level domain over a third of all captures is asked for only if it is listed itself, and then a skewed side may be split at will.

Days are the unit of time: a capture later on a day sees that day's entries, as lists name days only. Rows without a host
skip the join, so they don't meet in one task.

Defined results: a null URL, or one without a host, matches nothing; so does a null day. Hosts compare without case,
user, port or final dot; an IPv6 host keeps its brackets. On one day a removal outweighs an addition. Repeated captures are each returned; repeated
entries count once, and one with a null category is a hit without a name; empty captures or lists give empty or clean results; extra columns of captures pass through, those named like an
output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.runtime import Stages, without

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
MOST_KEYS = 200_000  # listed keys that may be broadcast
SEGMENTS = 3  # leading path segments of ``url_parts``; ``evaluate`` takes as many as the longest prefix entry has


def url_parts(captures: DataFrame, url_col: str = "url", most: int = SEGMENTS) -> DataFrame:
    """``captures`` with host (null where there is none) and path (its first segments, without a final slash)."""
    host = F.rtrim(F.lower(F.regexp_extract(F.col(url_col), HOST, 1)), F.lit("."))
    segments = F.filter(F.split(F.regexp_extract(F.col(url_col), PATH, 1), "/"), lambda s: s != "")
    parts = without(captures, "host", "path").withColumn("host", F.when(host != "", host))
    return parts.withColumn("path", F.when(F.col("host").isNotNull(), F.array_join(F.slice(segments, 1, most), "/")))


def entry_key():
    """An entry's key with its host in lower case; paths keep their case, as those of captures do."""
    host = F.substring_index("key", "/", 1)
    return F.when(F.col("kind") == "prefix", F.concat(F.lower(host), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"))).otherwise(F.lower("key"))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, category, valid_from, valid_to (exclusive; null: still valid) of every addition."""
    daily = entries.where(F.col("key").isNotNull() & F.col("day").isNotNull()).groupBy("kind", entry_key().alias("key"), "category", "day").agg(F.max("action").alias("action"))
    # At most one row a day for each key, so a window partition is bounded by the calendar.
    following = F.lead("day").over(Window.partitionBy("kind", "key", "category").orderBy("day"))
    return daily.withColumn("valid_to", following).where("action = 'add'").select("kind", "key", "category", F.col("day").alias("valid_from"), "valid_to")


def key_levels(listed: DataFrame) -> dict[str, list[int]]:
    """By kind, the numbers of host labels or path segments that entries' keys have: as few as a URL has parts."""
    level = F.when(F.col("kind") == "prefix", F.size(F.split("key", "/")) - 1).otherwise(F.size(F.split("key", r"\.")))
    found = listed.groupBy("kind").agg(F.collect_set(level).alias("levels")).collect()
    return {"domain": [], "prefix": []} | {r.kind: sorted(r.levels) for r in found}


def candidate_keys(levels: dict[str, list[int]]):
    """array<struct<kind,key>> of the keys that could name a (host, path) row: only of lengths that some entry has."""
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    size = F.size(labels)
    parents = F.transform(F.filter(F.sequence(F.lit(1), size), lambda i: (size - i + 1).isin(levels["domain"])), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, size), ".").alias("key")))
    asked = F.filter(F.sequence(F.lit(1), F.size(segments)), lambda i: i.isin(levels["prefix"]))
    prefixes = F.when(F.col("path") != "", F.transform(asked, lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("key"))))
    return F.concat(parents, F.coalesce(prefixes, F.array().cast("array<struct<kind:string,key:string>>")))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """``captures`` with host, hits (entries active on the fetch day), categories (sorted, comma-separated) and blocked."""
    listed = Stages(captures.sparkSession, "url-filter").write(intervals(entries), "listed")
    levels, names = key_levels(listed), listed.select("kind", "key").distinct()
    rows = url_parts(without(captures, "hits", "categories", "blocked"), url_col, max([1, *levels["prefix"]]))
    day = F.col(day_col)
    able = F.col("host").isNotNull() & day.isNotNull()
    asked = rows.where(able).select("host", "path", day.alias("day")).distinct()
    wanted = asked.select("host", "path", "day", F.inline(candidate_keys(levels)))
    known = names.count()
    if known <= MOST_KEYS:
        # Keys that no entry has, such as a domain over all others, go before anything is shuffled.
        wanted = wanted.join(F.broadcast(names), ["kind", "key"], "left_semi")
    met = wanted.join(listed, ["kind", "key"]).where((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    verdict = met.groupBy("host", "path", "day").agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    verdict = verdict.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("day").alias("_day"), "hits", "categories")
    found = rows.where(able).join(verdict, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")) & (day == F.col("_day")), "left")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "path"]
    named = found.select(*kept, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("categories", F.lit("")).alias("categories"), F.col("hits").isNotNull().alias("blocked"))
    return named.union(rows.where(~able).select(*kept, F.lit(0).cast("long"), F.lit(""), F.lit(False)))
