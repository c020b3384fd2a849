"""The scan of pages from lines to final detections: every source of matches, one policy, duplicates and shadows removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import checks, detectors, fixed
from maskwright.functions.patterns import SPACE
from maskwright.operators import pages, review, spatial, words
from maskwright.operators.spatial import BOX
from maskwright.sources.tables import written

HINTS = ["labeled", "ocr_corrected", "carrier_skipped", "iban_checksum_valid", "iban_checksum_failed"]


def _made(rows: DataFrame, keys: list[str], source: str, kind: str | Column, span: str = "text", **given: Column) -> DataFrame:
    """Rows of another source in the detectors' columns; flags that it doesn't give are false."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    given = {"rule_id": F.lit(None).cast("string"), "hint": F.lit(None).cast("string"), **{h: F.lit(False) for h in HINTS}, **given}
    names = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in fixed.LABELS.items()], F.when(F.col("rule_id") == "iban", F.lit(fixed.LABELS["iban"])))
    rows = rows.withColumn("type", kind).withColumns(given)
    boxes = [c for c in [*BOX, "confidence"] if c in rows.columns]
    start = F.col("start") if "start" in rows.columns else F.lit(None).cast("int")
    return rows.select(*keys, F.col("line_index").cast("int").alias("line_index"), F.lit(source).alias("source"), "type", "rule_id", names.alias("label"), "text", F.col(span).alias("span"), start.alias("start"), "hint", *HINTS, *boxes)


def _over_line_ends(lines: DataFrame, keys: list[str], at: list[str], named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wrapped account numbers of pages, the rows of account numbers and bearer tokens that go over line ends, placed in ``named``'s lines)."""
    wrapped = pages.wrapped_ibans(lines, keys)
    own = [k for k in keys if k in at]
    pieces = wrapped.select(*own, "text", "compact", F.explode("parts").alias("_p")).select(*own, "text", "compact", "_p.line_index", "_p.span").distinct()
    sound = checks.mod97(F.col("compact")) == 1
    numbers = _made(pieces, own, "wrapped_iban", "custom_rule", "span", rule_id=F.lit("iban"), iban_checksum_valid=sound, iban_checksum_failed=~sound)
    tokens = _made(pages.wrapped_bearer_tokens(lines, keys).select(*at, "text", "span").distinct(), own, "wrapped_bearer", "bearer_token", "span")
    return wrapped, _located(numbers.unionByName(tokens), named, at)


def _may_wrap(text: Column) -> Column:
    """Whether an account number or a bearer token may go on in the next line; most texts have no digit, which is soon seen."""
    return (text.rlike("[0-9]") & text.rlike("[A-Za-z]{2}[0-9]{2}[A-Za-z0-9 -]*$")) | text.rlike("[bB][eE][aA][rR][eE][rR]")


def detect_text(lines: DataFrame, keys: list[str], page_col: str = "page", **options) -> DataFrame:
    """``pages.detect_lines`` over texts laid out by ``pages.lay_out``, with account numbers and bearer tokens that go over a line's end, also a page's.

    ``keys`` name the text. Rows are of one line: a value over two lines is two rows with one ``text``.
    """
    at, page = [*keys, "line_index"], [*keys, page_col]
    found = pages.detect_lines(lines, keys, **options)
    few = pages.that_hold(pages.rolled(lines, page_col), page, _may_wrap(F.col("text")))
    wrapped, over = _over_line_ends(few, page, at, lines)
    shown = {"occurrence": F.lit(0), "listed": F.lit(True), "key": F.lit(None).cast("string"), "needs_review": F.lit(False)}
    over = over.withColumns(shown).select(*found.columns) if not options.get("carry") else pages.meet(over.withColumns(shown), lines.select(*at, *options["carry"]).distinct(), at).select(*found.columns)
    return pages.without_iban_heads(found, wrapped, keys).unionByName(over)


def scan(lines: DataFrame, keys: list[str], tool: list[str] | None = None, wordlist: DataFrame | None = None, rules: tuple = tuple(detectors.SAMPLE_RULES)) -> DataFrame:
    """Final detections of pages, with boxes, review columns and an id; ``tool`` limits the types shown.

    Sources: the line detectors, at every place of a value; private keys over lines; values that words make up together; addresses put
    together from pieces; phones over rows of words; account numbers, bearer tokens and, given a word list, seed phrases that go over
    line ends. Type limits come last, as hidden types still cast shadows.
    """
    at = [*keys, "line_index"]
    # Words are cut only from lines, or pages, that may hold what is sought over them: most hold nothing, and words are many times the lines.
    cut = lambda some: pages.words_of(some, keys)
    text = F.col("text")
    found = pages.detect_lines(lines, keys, rules=rules)
    found = found.select(*at, F.lit("line").alias("source"), "type", "rule_id", "label", "text", "span", F.col("start").cast("int").alias("start"), "hint", *HINTS)
    placed = [found.where(F.col("start").isNotNull())]

    wrapped, over = _over_line_ends(pages.that_hold(lines, keys, _may_wrap(text)), keys, at, lines)
    placed.append(over)
    placed.append(_located(_made(words.values_beside_labels(cut(lines.where(words.may_be_beside(text))), keys), keys, "beside", F.col("type")), lines, at))
    if wordlist is not None:
        seeds = pages.seed_phrase_lines(lines, keys, wordlist)
        placed.append(_located(_made(seeds, keys, "seed", "seed_phrase", "span", hint=F.lit("seed")), lines, at))
    boxed = placed[0]
    for more in placed[1:]:
        boxed = boxed.unionByName(more)
    # Read twice, and found at a far higher cost than it is kept at.
    boxed = written(boxed, "placed")
    boxed = pages.place(boxed, cut(pages.meet(lines, boxed.select(*at).distinct(), at, "left_semi")), keys, grow=True)

    grouped = _made(words.grouped_secrets(cut(lines.where(words.may_be_grouped(text))), keys), keys, "grouped", F.col("type"), rule_id=F.col("rule_id"), iban_checksum_valid=(F.col("rule_id") == "iban") & checks.iban_checksum(F.col("text")), iban_checksum_failed=F.coalesce((F.col("rule_id") == "iban") & ~checks.iban_checksum(F.col("text")), F.lit(False)))
    phones = _made(words.phones_in_rows(cut(words.may_hold_phones(lines, keys)), keys).withColumnRenamed("row", "line_index"), keys, "row", "phone", ocr_corrected=F.col("ocr_corrected"))
    pieces = _made(pages.fragments(cut(lines.where(text.rlike(":.*:"))), keys), keys, "pieces", "ipv6")
    union = boxed.unionByName(grouped).unionByName(phones).unionByName(pieces)
    union = union.withColumns({h: F.coalesce(h, F.lit(False)) for h in HINTS})
    judged = review.in_profile(review.add_review(pages.without_iban_heads(union, wrapped, keys), "confidence"))
    order = F.array_position(F.array(*map(F.lit, ["row", "grouped", "pieces", "beside", "line", "wrapped_iban", "wrapped_bearer", "seed"])), F.col("source"))
    single = spatial.deduplicate(judged.withColumn("ordinal", F.struct(order.alias("a"), F.col("line_index").alias("b"), F.coalesce("start", F.lit(0)).alias("c"), F.col("span").alias("d"))), keys)
    # What differs between two detections of a page is in the id whole, so no two share one.
    named = single.withColumn("id", F.sha2(F.concat_ws("\x00", "source", "type", F.coalesce("rule_id", F.lit("")), "line_index", F.coalesce("start", F.lit(-1)), "x0", "y0", "x1", "y1", "span", "text"), 256))
    # Suppression reads its rows three times.
    return review.for_tool(spatial.suppress(written(named, "named"), keys), tool or []).drop("ordinal")


def _located(rows: DataFrame, lines: DataFrame, at: list[str]) -> DataFrame:
    """Rows whose span is found in its line, with its place there; blanks inside the line's copy of it don't count."""
    found = pages.meet(rows.drop("start"), lines.select(*at, F.col("text").alias("_line")), at)
    bare = lambda c: F.regexp_replace(c, f"{SPACE}+", "")
    solid = SPACE.replace("[", "[^", 1)
    upto = lambda n, tail: F.length(F.call_function("regexp_extract", F.col("_line"), F.concat(F.lit(f"^((?:{SPACE}*{solid}){{"), n.cast("string"), F.lit("}" + tail + ")")), F.lit(1)))
    found = found.withColumns({"_whole": F.instr(F.col("_line"), F.col("span")), "_bare": F.instr(bare(F.col("_line")), bare(F.col("span")))}).where("_bare > 0")
    first = F.when(F.col("_whole") > 0, F.col("_whole") - 1).otherwise(upto(F.col("_bare") - 1, f"{SPACE}*"))
    last = F.when(F.col("_whole") > 0, F.col("_whole") - 1 + F.length("span")).otherwise(upto(F.col("_bare") - 1 + F.length(bare(F.col("span"))), ""))
    placed = found.withColumns({"start": first, "_end": last})
    return placed.withColumn("span", F.expr("substring(_line, start + 1, _end - start)")).drop("_line", "_whole", "_bare", "_end")


def redact(lines: DataFrame, keys: list[str], style: str = "blackout", confirmed: bool = False, **limits) -> DataFrame:
    """Rectangles of what may be covered on pages laid out by ``pages.lay_out``: the page ends at its last line."""
    found = review.automatic(scan(lines, keys, **limits), confirmed)
    size = lines.groupBy(*keys).agg((F.max("x1") + 10).alias("width"), (F.max("y1") + 10).alias("height"))
    return spatial.redactions(found.join(size, keys), style)
