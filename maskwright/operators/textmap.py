"""From characters back to words: lines out of free words, texts joined from words with their places, and the boxes of what is found in them.

Words are rows (keys, line_index, word_index, text, x0..y1). A joined text is one row a page or a window of lines, with the place of each of its
words as an array; places are running sums over the page, whose size bounds them. Boxes are the words' own: nothing is taken to be in proportion.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions import text as T
from maskwright.functions.patterns import SPACE, bound
from maskwright.operators import boxes, pages
from maskwright.operators.joins import meet
from maskwright.operators.spatial import BOX

# How far a word's middle may lie from a line's, and the heights of buckets for items without line ends.
BAND, LEAST_BAND, BUCKET, LEAST_BUCKET = 0.55, 5.0, 0.65, 6.0
# Up to so many spans all are looked at sooner than a place is found by halving.
FEW_SPANS = 32


def visual_groups(words: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` with ``line_index``: the line that each belongs to by its middle alone, from 0 in the order in which lines begin.

    Words are taken from the top. One joins the first line whose mean middle is within ``BAND`` of the greater height, and moves that mean;
    else it begins a line. ``order`` breaks ties between equal middles.
    """
    middle, height = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    own = [c for c in words.columns if c not in keys and c != "line_index"]
    item = F.struct(middle.alias("m"), F.col("word_index").alias("o"), height.alias("h"), *[F.col(c).alias(f"w_{c}") for c in own])
    page = words.where(F.trim("text") != "").groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_w"))
    line = "struct<m:double,h:double,n:int,at:array<int>>"
    begin = F.array().cast(f"array<{line}>")

    def step(lines: Column, x: Column) -> Column:
        near = F.transform(lines, lambda l: F.abs(l["m"] / l["n"] - x["m"]) <= F.greatest(F.lit(LEAST_BAND), F.greatest(l["h"] / l["n"], x["h"]) * BAND))
        hit = F.array_position(near, F.lit(True))
        new = F.struct(x["m"].alias("m"), x["h"].alias("h"), F.lit(1).alias("n"), F.array(x["i"]).alias("at")).cast(line)
        grown = F.transform(lines, lambda l, k: F.when(k + 1 == hit, F.struct((l["m"] + x["m"]).alias("m"), (l["h"] + x["h"]).alias("h"), (l["n"] + 1).alias("n"), F.array_append(l["at"], x["i"]).alias("at")).cast(line)).otherwise(l))
        return F.when(hit > 0, grown).otherwise(F.array_append(lines, new))

    numbered = F.transform("_w", lambda w, i: F.struct(w["m"].alias("m"), w["h"].alias("h"), i.alias("i")))
    lines = page.withColumn("_l", F.aggregate(numbered, begin, step)).select(*keys, "_w", F.posexplode("_l").alias("line_index", "_line"))
    each = lines.select(*keys, "line_index", "_w", F.explode("_line.at").alias("_at")).select(*keys, "line_index", F.get("_w", F.col("_at")).alias("_x"))
    return each.select(*keys, "line_index", *[F.col(f"_x.w_{c}").alias(c) for c in own])


def lines_of_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_index, text (words by x, joined by blanks), n_words, box and confidence of each line."""
    item = F.struct("x0", "word_index", "text")
    grouped = words.groupBy(*keys, "line_index").agg(F.sort_array(F.collect_list(item)).alias("_w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("confidence").alias("confidence") if "confidence" in words.columns else F.lit(100.0).alias("confidence"))
    return grouped.select(*keys, "line_index", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"), F.size("_w").alias("n_words"), *BOX, "confidence")


def item_words(items: DataFrame, keys: list[str], viewport: list[float]) -> DataFrame:
    """Words of a page's text items (keys, item, text, transform, width, ends_line): keys, line_index, word_index, text, x0..y1, confidence.

    A line goes on until an item that ends it; blank items and those without a box end lines as well. Where a page has one line
    only, its words are dealt to lines by their middles.
    """
    before = Window.partitionBy(*keys).orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("_line", F.coalesce(F.sum(F.col("ends_line").cast("int")).over(before), F.lit(0)))
    boxed = boxes.item_boxes(rows.where(F.trim(F.coalesce("text", F.lit(""))) != ""), viewport)
    cut = pages.words_of(boxed.withColumns({"line_index": F.lit(0), "confidence": F.lit(100.0)}), [*keys, "item", "_line"])
    page = Window.partitionBy(*keys)
    order = page.orderBy("_line", "item", "_k")
    found = cut.withColumn("_k", F.col("word_index")).withColumns({"word_index": F.row_number().over(order) - 1, "_lines": F.max("_line").over(page) - F.min("_line").over(page), "_all": F.count("*").over(page)})
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    bucket = F.floor((F.col("y0") + height / 2) / F.greatest(F.lit(LEAST_BUCKET), height * BUCKET) + 0.5)
    found = found.withColumn("_bucket", F.when((F.col("_lines") == 0) & (F.col("_all") > 1), bucket))
    # Buckets are numbered in the order in which their first words come.
    first = found.withColumn("_first", F.min("word_index").over(Window.partitionBy(*keys, "_bucket")))
    ranked = first.withColumn("_rank", F.dense_rank().over(page.orderBy("_first")) - 1)
    return ranked.withColumn("line_index", F.when(F.col("_bucket").isNull(), F.col("_line")).otherwise(F.col("_rank")).cast("int")).select(*keys, "line_index", "word_index", "text", *BOX, "confidence")


def joined_text(words: DataFrame, keys: list[str], line_order: Column | None = None) -> DataFrame:
    """keys, text and spans of each page: its lines from the top, their words by x, all joined by single blanks.

    spans: array<struct<start, end, line_index, place, run, x0..y1>>, in the order of the text. ``run`` numbers the pieces of a line that stand
    close enough to be one cut token. ``line_order`` puts lines in another order than that of their tops.
    """
    line = Window.partitionBy(*keys, "line_index")
    rows = words.where((F.col("text") != "") & F.col("x0").isNotNull() & F.col("x1").isNotNull()).withColumn("_top", F.min("y0").over(line) if line_order is None else line_order)
    rows = pages.with_runs(rows, keys)
    order = Window.partitionBy(*keys).orderBy("_top", "line_index", "_place")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.length("text") + 1).over(upto), F.lit(0)))
    item = F.struct(F.col("_start").cast("int").alias("start"), (F.col("_start") + F.length("text")).cast("int").alias("end"), F.col("line_index").cast("int").alias("line_index"), F.col("_place").alias("place"), F.col("_run").cast("int").alias("run"), *[F.col(c).cast("double").alias(c) for c in BOX], F.col("text").alias("_t"))
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("spans"))
    return grouped.select(*keys, F.array_join(F.transform("spans", lambda w: w["_t"]), " ").alias("text"), "spans")


def window_text(windows: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """``joined_text`` of chains of lines (keys, line_index, line_indexes, as ``pages.wrapped_windows`` gives them), by keys and line_index."""
    lines = windows.select(*keys, F.col("line_index").alias("_window"), F.posexplode("line_indexes").alias("_nth", "line_index"))
    met = meet(words, lines, [*keys, "line_index"])
    return joined_text(met, [*keys, "_window"], F.col("_nth")).withColumnRenamed("_window", "line_index")


def _nth(text: Column, value: Column, n: Column) -> Column:
    """The place of occurrence ``n`` of ``value``, from 0, without overlaps; -1 where there are fewer."""
    step = lambda s, _: F.when(s["at"] < 0, s).otherwise(_found(text, value, s["next"]))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("next"))
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))), start, step, lambda s: s["at"])


def _found(text: Column, value: Column, start: Column) -> Column:
    return bound(F.call_function("locate", value, text, start + 1) - 1, lambda at: F.struct(at.alias("at"), (at + F.length(value)).alias("next")))


def match_range(text: Column, match: Column, occurrence: Column) -> Column:
    """struct<start, size> of a value in a text: as it is, else without blanks, else without blanks, dashes and underscores; null where it is nowhere.

    Case and Turkish marks don't count, and the case ending of a name goes with it.
    """
    place = lambda start, size: F.struct(start.alias("start"), size.alias("size"))

    def as_it_is(folded: Column, wanted: Column) -> Column:
        return bound(_nth(folded, wanted, occurrence), lambda at: F.when(at >= 0, place(at, F.length(wanted))))

    def without(folded: Column, wanted: Column, dropped: str) -> Column:
        def among(kept: Column, short: Column, needle: Column) -> Column:
            first, last = (lambda at: F.get(kept, at)), (lambda at: F.get(kept, at + F.length(needle) - 1))
            return bound(F.when(needle != "", _nth(short, needle, occurrence)).otherwise(-1), lambda at: F.when(at >= 0, place(first(at) - 1, last(at) - first(at) + 1)))

        # Places of the characters that stay, from 1, and they themselves.
        stay = F.filter(F.transform(F.split(folded, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i"))), lambda x: ~x["c"].rlike(f"^{dropped}$"))
        needle = F.regexp_replace(wanted, dropped, "")
        return bound(stay, lambda s: among(s["i"], F.regexp_replace(folded, dropped, ""), needle))

    def sought(line: Column, value: Column) -> Column:
        def over(x: Column) -> Column:
            return F.coalesce(as_it_is(x["f"], x["w"]), without(x["f"], x["w"], f"{SPACE}"), without(x["f"], x["w"], f"(?:{SPACE}|[_-])"))

        found = bound(F.struct(T.fold_turkish(line).alias("f"), T.fold_turkish(value).alias("w")), over)
        return bound(found, lambda r: F.when(r.isNotNull(), place(r["start"], T.extend_name_suffix(line, r["start"], r["size"]))))

    def read(value: Column) -> Column:
        bare = F.regexp_replace(value, "[^0-9]", "")
        line = F.when(F.startswith(bare, F.lit("0")) & (F.length(bare) >= 10), T.rewrite_trunk_o(text)).otherwise(text)
        return F.when((value != "") & (text != ""), bound(line, lambda own: sought(own, value)))

    return bound(F.trim(match), read)


def words_in_range(spans: Column, start: Column, end: Column) -> Column:
    """The spans that a range of the joined text touches.

    Both bounds are found by halving where there are many, as spans are in order: the first that ends after ``start``, and how many begin before ``end``.
    """
    few = lambda r: F.filter(spans, lambda w: (w["end"] > r["a"]) & (w["start"] < r["b"]) & (r["a"] < r["b"]))

    def within(a: Column, b: Column) -> Column:
        first, beyond = _bound(spans, lambda w: w["end"] > a), _bound(spans, lambda w: w["start"] >= b)
        return bound(first, lambda at: F.slice(spans, at + 1, F.when(b > a, F.greatest(beyond - at, F.lit(0))).otherwise(0)))

    return bound(F.struct(start.alias("a"), end.alias("b")), lambda r: F.when(F.size(spans) <= FEW_SPANS, few(r)).otherwise(within(r["a"], r["b"])))


def _bound(spans: Column, test) -> Column:
    """The number of spans before the first that passes ``test``, which all after it pass too."""
    begin = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        cut = lambda middle: F.when(s["lo"] >= s["hi"], s).when(test(F.get(spans, middle)), F.struct(s["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")))
        return bound(F.floor((s["lo"] + s["hi"]) / 2).cast("int"), cut)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.aggregate(rounds, begin, halve, lambda s: s["lo"])


def grown(matched: Column, spans: Column, most: int = pages.MOST_PIECES) -> Column:
    """``matched`` with the pieces of a cut token that stand close after its last word, ``most`` at most."""

    def longer(words: Column) -> Column:
        more = lambda last: F.filter(spans, lambda w: (w["line_index"] == last["line_index"]) & (w["run"] == last["run"]) & (w["place"] > last["place"]) & (w["place"] <= last["place"] + most))
        return F.when(F.size(words) > 0, F.concat(words, bound(F.get(words, F.size(words) - 1), more))).otherwise(words)

    return bound(matched, longer)


_BLANKS, _MARKS = f"{SPACE}", f"(?:{SPACE}|[_-])"
_EVERY_BLANK = "".join(c for c in map(chr, range(0x10000)) if re.match(SPACE, c))


def _readings(text: Column) -> Column:
    """struct<f, short, at, bare, bare_at, o>: a text as ``match_range`` reads it, so that it is made once for all that is sought in it: folded, without blanks
    and without dashes as well, each with the places (from 1) of the characters that stay; and the text with zeros for letters O that stand alone.
    """

    def cut(f: Column) -> Column:
        places = F.transform(F.split(f, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i")))

        def kept(short: Column) -> Column:
            at = lambda x: F.transform(x, lambda c: c["i"])
            bare = F.filter(short, lambda x: (x["c"] != "-") & (x["c"] != "_"))
            return bound(bare, lambda b: F.struct(f.alias("f"), F.regexp_replace(f, _BLANKS, "").alias("short"), at(short).alias("at"), F.regexp_replace(f, _MARKS, "").alias("bare"), at(b).alias("bare_at"), T.rewrite_trunk_o(text).alias("o")))

        return bound(F.filter(places, lambda x: ~F.contains(F.lit(_EVERY_BLANK), x["c"])), kept)

    return bound(T.fold_turkish(text), cut)


def _first_range(text: Column, read: Column, match: Column) -> Column:
    """``match_range`` of a value's first occurrence, over what ``_readings`` gave; zeros for letters O take the plain way."""
    place = lambda start, size: F.struct(start.alias("start"), size.alias("size"))
    apostrophe = "['’´`]"

    def among(short: Column, kept: Column, needle: Column) -> Column:
        found = bound(F.call_function("locate", needle, short), lambda at: F.when(at > 0, bound(F.get(kept, at - 1), lambda a: place(a - 1, F.get(kept, at + F.length(needle) - 2) - a + 1))))
        return F.when(needle != "", found)

    def sought(w: Column) -> Column:
        whole = bound(F.call_function("locate", w, read["f"]), lambda at: F.when(at > 0, place(at - 1, F.length(w))))
        short = bound(F.regexp_replace(w, _BLANKS, ""), lambda n: among(read["short"], read["at"], n))
        bare = bound(F.regexp_replace(w, _MARKS, ""), lambda n: among(read["bare"], read["bare_at"], n))
        return F.coalesce(whole, short, bare)

    def ended(r: Column) -> Column:
        after = F.substring(text, r["start"] + r["size"] + 1, F.lit(1))
        return F.when(r.isNotNull(), place(r["start"], F.when(after.rlike(apostrophe), T.extend_name_suffix(text, r["start"], r["size"])).otherwise(r["size"])))

    def over(value: Column) -> Column:
        bare = F.regexp_replace(value, "[^0-9]", "")
        zeros = (read["o"] != text) & F.startswith(bare, F.lit("0")) & (F.length(bare) >= 10)
        plain = bound(bound(T.fold_turkish(value), sought), ended)
        return F.when((value != "") & (text != ""), F.when(zeros, match_range(text, value, F.lit(0))).otherwise(plain))

    return bound(F.trim(match), over)


def match_boxes(matches: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of ``matches`` (keys, text, and type, occurrence where known) with line_index and box: one row for each line that a match touches.

    ``texts``: what ``joined_text`` gave. Matches of types whose tokens scanners cut take the pieces after them along. What is nowhere has no row.
    """
    own = [c for c in matches.columns if c not in keys]
    sought = matches.select(*keys, *[F.col(c).alias(f"_m_{c}") for c in own])
    if "occurrence" in own:
        met = meet(sought, texts.select(*keys, F.col("text").alias("_text"), "spans"), keys)
        found = match_range(F.col("_text"), F.col("_m_text"), F.col("_m_occurrence"))
    else:
        met = meet(sought, texts.select(*keys, F.col("text").alias("_text"), "spans", _readings(F.col("text")).alias("_read")), keys)
        found = _first_range(F.col("_text"), F.col("_read"), F.col("_m_text"))
    # As rows of an array of one the range is worked out once; a filter over it would be worked out again below.
    place = F.filter(F.array(found), lambda r: r.isNotNull())
    met = met.select(*keys, *[f"_m_{c}" for c in own], "spans", F.explode(place).alias("_r"))
    touched = words_in_range(F.col("spans"), F.col("_r.start"), F.col("_r.start") + F.col("_r.size"))
    if "type" in own:
        touched = F.when(F.col("_m_type").isin(fixed.CUT_TYPES), grown(touched, F.col("spans"))).otherwise(touched)
    met = met.withColumn("_w", touched)
    lines = met.select(*keys, *[f"_m_{c}" for c in own], "_w", F.explode(F.array_distinct(F.transform("_w", lambda w: w["line_index"]))).alias("_line"))
    mine = lines.withColumn("_w", F.filter("_w", lambda w: w["line_index"] == F.col("_line")))
    side = lambda c, f: f(F.transform("_w", lambda w: w[c])).alias(c)
    named = [F.col(f"_m_{c}").alias(c) for c in own if c not in ("line_index", *BOX)]
    return mine.select(*keys, F.col("_line").alias("line_index"), *named, side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max), F.size("_w").alias("n_words"))
