"""Detectors and validators as functions of the session's SQL: ``SELECT * FROM documents, LATERAL detect_email(text)``.

Each is a SQL function whose body is the Column expression that the library itself runs, written out; so queries that call it stay inside
Catalyst, with no Python worker. Functions are temporary: they belong to the session that ``register`` was called for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import checks, detectors
from maskwright.functions import text as T

# Types, and the families of hits that lead to them.
FAMILIES = {
    **{t: [t] for t in ("email", "ipv4", "ipv6", "credit_card", "phone", "tckn", "vkn", "api_token", "connection_url", "bearer_token", "env_secret", "passport", "session_id", "private_key", "location")},
    "ssn": ["ssn", "nine"],
    "routing_number": ["nine"],
    "person_name": ["person_name", "name_pair"],
}
VALIDATORS = {"luhn": checks.luhn, "tckn": checks.tckn, "vkn": checks.vkn, "ssn": checks.ssn, "routing_number": checks.aba, "iban": checks.iban_checksum, "ipv4": checks.ipv4, "ipv6": checks.ipv6}
VALUE = "array<struct<text:string,span:string,start:int,hint:string>>"

_TOKENS = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(and|or|not|[!<>=+*/%&|^-]+)\(", re.S)


def as_sql(column: Column) -> str:
    """``column`` as SQL text. Operators are written as calls of functions of their names."""
    return _TOKENS.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], column._jc.node().sql())


def values(kind: str, text: Column) -> Column:
    """array<struct<text, span, start, hint>> of a type's values in ``text``, each at its place, in order; values put together from pieces come without a place."""
    hits = detectors.raw_hits(text, F.lower(text), T.fold_turkish(text), (), [kind])

    def decided(h: Column) -> Column:
        fields = {c: h[c] for c in ("raw", "start", "g1", "g2", "g3", "g4")}
        table, also = detectors.accepted(fields, text, ())
        chosen = None
        for family in FAMILIES[kind]:
            found = table[family] if family == "nine" else detectors.first_of(table[family])
            chosen = F.when(h["family"] == family, found) if chosen is None else chosen.when(h["family"] == family, found)
        mine = F.filter(F.coalesce(chosen, F.array().cast("array<struct<type:string,text:string,span:string,hint:string>>")), lambda m: m["type"] == kind)
        tail = lambda m: F.length(h["raw"]) - F.length(m["span"])
        inner = {"bearer_token": tail, "passport": tail, "env_secret": lambda m: tail(m) - F.when((h["g2"] != "") | (h["g3"] != ""), 1).otherwise(0), "person_name": lambda m: F.when(h["family"] == "name_pair", also["name_at"]).otherwise(0)}.get(kind, lambda m: F.lit(0))
        place = lambda m: F.coalesce(h["start"] + inner(m), F.nullif(F.instr(text, m["span"]) - 1, F.lit(-1)))
        return F.transform(mine, lambda m: F.struct(m["text"].alias("text"), m["span"].alias("span"), place(m).cast("int").alias("start"), m["hint"].alias("hint")))

    return F.array_distinct(F.coalesce(F.flatten(F.transform(hits, decided)), F.array().cast(VALUE)))


def register(spark: SparkSession, types: list[str] | None = None) -> list[str]:
    """Creates ``detect_<type>(text)``, a table of text, span, start and hint, and ``valid_<kind>(text)``, a boolean; returns their names.

    ``types`` limits the detectors; with it no validators are made.
    A null text has no values and is valid as nothing.
    """
    made = []
    text = F.coalesce(F.col("value"), F.lit(""))
    for kind in FAMILIES if types is None else types:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION detect_{kind}(value STRING) RETURNS TABLE (text STRING, span STRING, start INT, hint STRING) RETURN SELECT inline({as_sql(values(kind, text))})")
        made.append(f"detect_{kind}")
    for name, test in VALIDATORS.items() if types is None else ():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION valid_{name}(value STRING) RETURNS BOOLEAN RETURN {as_sql(F.coalesce(test(text), F.lit(False)))}")
        made.append(f"valid_{name}")
    return made
