"""A table of user rules with versions: saved, deleted, switched on and off in commits of their own, and read as of any of them.

A change is a Parquet folder, and a commit is one small file in the log, numbered and made only if no one else has made it: of two writers
who reach for a number one takes the next. What no commit names doesn't exist, so a writer that dies leaves the table as it was. The rules
of a version are the last changes of each id up to it, by windows over ids; no version is rewritten.

Defined results: a row that makes no usable rule is left out, as in the settings; deleting or switching what isn't there changes nothing; a rule
that is saved again takes its new fields and keeps its place, one that was deleted comes last; an empty table has version 0 and no rules; texts
that are null match nothing. At most ``MOST`` rules can be applied at once, as each is a pattern over every row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions.detectors import Rule
from maskwright.functions.patterns import located, occurrences

CHANGES = "op string, seq int, id string, name string, type string, pattern string, enabled boolean"
MOST = 1000


def normal(row: dict) -> dict | None:
    """The fields of a settings row, cut to their limits; None where it makes no usable rule."""
    rule = Rule.of(row)
    return None if rule is None else {"id": rule.id, "name": rule.label, "type": row["type"], "pattern": str(row["pattern"]).strip()[:180], "enabled": rule.enabled}


class RuleTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(conf)

    def _log(self) -> dict[int, dict]:
        at = self._hadoop(f"{self.path}/log")
        if not self._files.exists(at):
            return {}
        out = {}
        for status in self._files.listStatus(at):
            name = status.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit():
                out[int(name[:-5])] = json.loads(self.spark.sparkContext._jvm.java.lang.String(self._files.open(status.getPath()).readAllBytes()))
        return dict(sorted(out.items()))

    def version(self) -> int:
        return max(self._log(), default=0)

    def _commit(self, rows: list[tuple]) -> int:
        folder = uuid.uuid4().hex
        self.spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{self.path}/changes/{folder}")
        while True:
            number = self.version() + 1
            try:
                out = self._files.create(self._hadoop(f"{self.path}/log/{number:020d}.json"), False)
            except Exception as taken:
                if "AlreadyExists" not in str(taken) and "already exists" not in str(taken):
                    raise
                continue
            out.write(json.dumps({"folder": folder}).encode())
            out.close()
            return number

    def save(self, rules: list[dict]) -> int:
        """Adds rules, or gives those of the same ids their new fields; returns the version."""
        good = [n for n in map(normal, rules) if n]
        return self._commit([("put", k, r["id"], r["name"], r["type"], r["pattern"], r["enabled"]) for k, r in enumerate(good)])

    def delete(self, ids: list[str]) -> int:
        return self._commit([("delete", k, i, None, None, None, None) for k, i in enumerate(ids)])

    def enable(self, ids: list[str], on: bool = True) -> int:
        return self._commit([("switch", k, i, None, None, None, on) for k, i in enumerate(ids)])

    def history(self, upto: int | None = None) -> DataFrame:
        """version and the columns of every change, up to a version."""
        log = {n: c["folder"] for n, c in self._log().items() if upto is None or n <= upto}
        out = self.spark.createDataFrame([], f"version int, {CHANGES}")
        if not log:
            return out
        numbers = self.spark.createDataFrame([(f, n) for n, f in log.items()], "folder string, version int")
        rows = self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/changes/{f}" for f in log.values()])
        named = rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"/changes/([0-9a-f]+)/", 1))
        return named.join(F.broadcast(numbers), "folder").select("version", *rows.columns)

    def rules(self, version: int | None = None) -> DataFrame:
        """position, id, name, type, pattern and enabled of the rules as of a version (the last by default)."""
        changes = self.history(version)
        mine = Window.partitionBy("id")
        order = mine.orderBy("version", "seq")
        at = F.struct("version", "seq")
        gone = F.max(F.when(F.col("op") == "delete", at)).over(mine)
        live = changes.withColumn("_gone", gone).where(F.col("_gone").isNull() | (at > F.col("_gone"))).drop("_gone")
        put = F.max(F.when(F.col("op") == "put", at)).over(mine)
        live = live.withColumns({"_put": put, "_first": F.min(F.when(F.col("op") == "put", at)).over(mine), "_switch": F.max(F.when(F.col("op") == "switch", F.struct("version", "seq", "enabled"))).over(mine), "_n": F.row_number().over(order)})
        last = live.where((F.col("op") == "put") & (at == F.col("_put")))
        on = F.when(F.struct("_switch.version", "_switch.seq") > F.struct("version", "seq"), F.col("_switch.enabled")).otherwise(F.col("enabled"))
        return last.select(F.col("_first").alias("position"), "id", "name", "type", "pattern", on.alias("enabled")).dropDuplicates(["id"])

    def matches(self, rows: DataFrame, keys: list[str], text_col: str = "text", version: int | None = None) -> DataFrame:
        """keys, rule_id, label, text and start of every match of the enabled rules as of a version.

        Keywords come to the rows by a join with the table, as one array, and are looked for without case; expressions are patterns
        of the plan.
        """
        live = self.rules(version).where("enabled")
        counts = live.agg(F.count("*").alias("n")).first().n
        if counts > MOST:
            raise ValueError(f"{counts} rules: over {MOST} can't be applied at once")
        words = live.where("type = 'keyword'").select(F.collect_list(F.struct("id", "name", F.lower("pattern").alias("word"))).alias("_rules")).withColumn("_one", F.lit(1))
        texts = rows.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumns({"_low": F.lower("_text"), "_one": F.lit(1)})
        held = texts.join(F.broadcast(words), "_one").select(*keys, "_text", "_low", F.explode(F.filter("_rules", lambda r: F.contains(F.col("_low"), r["word"]))).alias("_r"))
        found = held.select(*keys, "_text", F.col("_r.id").alias("rule_id"), F.col("_r.name").alias("label"), F.explode(occurrences(F.col("_low"), F.col("_r.word"), whole=False)).alias("_at"))
        out = found.select(*keys, "rule_id", "label", F.substring("_text", F.col("_at.start") + 1, F.col("_at.size")).alias("text"), F.col("_at.start").alias("start"))
        for r in live.where("type = 'regex'").collect():
            hits = texts.select(*keys, F.explode(located(F.col("_text"), r.pattern)).alias("_h")).where(F.trim("_h.raw") != "")
            out = out.unionByName(hits.select(*keys, F.lit(r.id).alias("rule_id"), F.lit(r["name"]).alias("label"), F.col("_h.raw").alias("text"), F.col("_h.start").alias("start")))
        return out


def try_pattern(spark: SparkSession, pattern: str, sample: str, kind: str = "regex") -> tuple[bool, list[str]]:
    """(whether a pattern makes a rule, what it finds in a sample)."""
    rule = Rule.of({"id": "pattern-test", "name": "Pattern test", "pattern": pattern, "type": kind})
    if rule is None:
        return False, []
    row = spark.createDataFrame([(sample,)], "t string")
    found = located(F.col("t"), ("(?i)" if rule.ignore_case else "") + rule.pattern)
    return True, [h.raw for h in row.select(found.alias("h")).first().h]
