"""Regular expressions as Spark columns: portable classes, and all matches with their positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII counts; word boundaries are ASCII ones, whatever the Java version takes \b for.
SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def spelled(pattern: str) -> str:
    r"""``pattern`` with \b, \s and \S written out; a class inside a class is a union in Java."""
    return pattern.replace(r"\b", EDGE).replace(r"\s", SPACE).replace(r"\S", NOT_SPACE)


def bound(value: Column, use) -> Column:
    """``use(v)`` with ``value`` worked out once: what a lambda's body names is worked out for each element, and what is named twice is twice."""
    return F.get(F.transform(F.array(value), use), 0)


def any_of(words: list[str]) -> str:
    """A pattern for any of the plain ``words``; beginnings that they share are tried once, as a search tries each alternative at each place."""
    tails: dict[str, list[str]] = {}
    for w in sorted({w for w in words if w}):
        tails.setdefault(w[0], []).append(w[1:])
    own = lambda c: c if c.isalnum() or c == " " else re.escape(c)
    made = [own(c) + (f"(?:{any_of(rest)})" + ("?" if "" in rest else "") if any(rest) else "") for c, rest in tails.items()]
    return "|".join(made)


def matches(text: Column, pattern: str) -> Column:
    """array<string> of all matches, in order."""
    return F.regexp_extract_all(text, F.lit(spelled(pattern)), F.lit(0))


# Noncharacters around each match, and before each of its groups: no text holds them, and should one, it is read as a replacement character.
_OPEN, _GROUP, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def _marked(text: Column, full: str, groups: int = 0) -> Column:
    """The text cut before each match of ``full``; a match's part goes on with its groups and, after the closing mark, with the text up to the next."""
    plain = F.translate(text, _OPEN + _GROUP + _CLOSE, "\ufffd" * 3)
    return F.split(F.regexp_replace(plain, full, _OPEN + "$0" + "".join(f"{_GROUP}${k}" for k in range(1, groups + 1)) + _CLOSE), _OPEN, -1)


def located(text: Column, pattern: str, groups: int = 0, most_groups: int = 4) -> Column:
    """array<struct<start, raw, g1..g4>> of all matches: start counts code points from 0.

    The pattern runs over the text once and leaves marks around its matches; positions are the running sum of the lengths between marks, so no
    row leaves the JVM. Groups that took no part are empty.
    """
    full = spelled(pattern)
    hit = "struct<start:int,raw:string," + ",".join(f"g{k}:string" for k in range(1, most_groups + 1)) + ">"
    empty = F.array().cast(f"array<{hit}>")

    def step(seen: Column, p: Column) -> Column:
        def of(fields: Column) -> Column:
            raw = F.get(fields, 0)
            named = [(F.get(fields, k) if k <= groups else F.lit("")).alias(f"g{k}") for k in range(1, most_groups + 1)]
            found = F.struct(seen["at"].alias("start"), raw.alias("raw"), *named)
            return F.struct((seen["at"] + F.length(raw) + F.length(F.substring_index(p, _CLOSE, -1))).alias("at"), F.array_append(seen["out"], found.cast(hit)).alias("out"))

        own = F.substring_index(p, _CLOSE, 1)
        return bound(F.split(own, _GROUP, -1) if groups else F.array(own), of)

    def summed(parts: Column) -> Column:
        begin = F.struct(F.length(F.get(parts, 0)).alias("at"), empty.alias("out"))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), begin, step, lambda s: s["out"])

    return F.when(text.rlike(full), bound(_marked(text, full, groups), summed)).otherwise(empty)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def before(text: Column, start: Column, size: int) -> Column:
    """Up to ``size`` characters in front of a position."""
    first = F.greatest(start - size, F.lit(0))
    return F.substring(text, first + 1, start - first)


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def blanked(text: Column, pattern: str) -> Column:
    """``text`` with blanks for every character of the matches, so that positions stay."""
    full = spelled(pattern)
    gap = lambda p: F.substring_index(p, _CLOSE, -1)
    joined = F.array_join(F.transform(_marked(text, full), lambda p: F.concat(F.repeat(F.lit(" "), F.length(p) - F.length(gap(p)) - F.when(F.contains(p, F.lit(_CLOSE)), 1).otherwise(0)), gap(p))), "")
    return F.when(text.rlike(full), joined).otherwise(text)


PLACE = "array<struct<start:int,size:int>>"


def occurrences(text: Column, value: Column, whole: bool = True) -> Column:
    """array<struct<start, size>>: where ``value`` stands in ``text``, without overlaps; as whole words, or anywhere."""
    size = F.length(value)
    many = F.when(size > 0, ((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / size).cast("int")).otherwise(0)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(PLACE).alias("out"))

    def step(s: Column, _: Column) -> Column:
        added = lambda at: F.struct((at + size).alias("at"), F.array_append(s["out"], F.struct(at.alias("start"), size.alias("size"))).alias("out"))
        return bound(F.call_function("locate", value, text, s["at"] + 1) - 1, added)

    glyph = lambda at: F.substring(text, at, F.lit(1))
    alnum = "[A-Za-z0-9]"
    apart = lambda x: ~(F.substring(value, 1, 1).rlike(alnum) & (x["start"] > 0) & glyph(x["start"]).rlike(alnum)) & ~(value.rlike(alnum + "$") & glyph(x["start"] + size + 1).rlike(alnum))

    def found(n: Column) -> Column:
        every = F.aggregate(F.sequence(F.lit(1), n), begin, step, lambda s: s["out"])
        return F.when(n > 0, F.filter(every, apart) if whole else every).otherwise(F.array().cast(PLACE))

    return bound(many, found)


#: What scanners add, drop or change inside a value.
LOOSE = "[" + SPACE[1:-1] + "\x00_\\-‐‑‒–—−＿﹍﹎]"


def loose_occurrences(text: Column, value: Column) -> Column:
    """As ``occurrences``, but blanks, dashes, underscores and case don't count: for values put together from pieces."""
    # Places of the characters that count, from 1.
    stay = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i"))), lambda x: ~x["c"].rlike(LOOSE))
    bare, wanted = F.lower(F.regexp_replace(text, LOOSE, "")), F.lower(F.regexp_replace(value, LOOSE, ""))
    none = F.array().cast(PLACE)
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def found(x: Column) -> Column:
        size = F.length(x["w"])
        many = F.when(size > 0, ((F.length(x["b"]) - F.length(F.replace(x["b"], x["w"], F.lit("")))) / size).cast("int")).otherwise(0)

        def over(kept: Column, n: Column) -> Column:
            def added(s: Column, at: Column) -> Column:
                first, last = F.get(kept, at - 1), F.get(kept, at + size - 2)
                return F.struct((at + size - 1).alias("at"), F.array_append(s["out"], F.struct((first - 1).alias("start"), (last - first + 1).alias("size"))).alias("out"))

            step = lambda s, _: bound(F.call_function("locate", x["w"], x["b"], s["at"] + 1), lambda at: added(s, at))
            return F.aggregate(F.sequence(F.lit(1), n), begin, step, lambda s: s["out"])

        return bound(many, lambda n: F.when(n > 0, bound(stay, lambda kept: over(kept["i"], n))).otherwise(none))

    return F.when(F.length(text) > 0, bound(F.struct(bare.alias("b"), wanted.alias("w")), found)).otherwise(none)
