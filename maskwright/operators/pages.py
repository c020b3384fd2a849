"""Positional operators: lines and words of pages, candidate windows, wrapped lines, and places of matches.

Pages are tables in long form. lines: keys, line_index, text, x0..y1, confidence; words: keys, line_index, word_index, text,
x0..y1, confidence. Windows run within a line or a page, whose size is bounded by what fits on it: ``lay_out`` begins a new page
every ``PAGE_LINES`` lines, however long a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import checks, fixed
from maskwright.functions import text as T
from maskwright.functions.patterns import SPACE, bound, spelled
from maskwright.operators.joins import meet
from maskwright.operators.spatial import BOX

# Layout of plain text as a page: one line for each line break, glyphs of one width.
GLYPH, HEIGHT, LEFT, TOP, GAP = 12, 16, 10, 20, 8
PAGE_LINES = 120
BLOCK = 64  # pieces of a line whose lengths are added up one after the other
# How near the next piece of a cut token stands, in glyphs and pixels, how long it may be, and how many are taken.
GLYPHS_APART, PIXELS_APART, PIECE_LENGTH, SHORT_PIECE, MOST_PIECES = 1.15, 0.5, 24, 3, 8
CONFIDENCE = 92.0


def lay_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of plain texts as pages of fixed-width glyphs; blank lines take their room and are dropped. line_index counts through the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line_index", "text"))
    rows = rows.select("doc_id", (F.floor(F.col("line_index") / PAGE_LINES) + 1).cast("int").alias("page"), "line_index", "text")
    top = F.lit(float(TOP)) + F.col("line_index") % PAGE_LINES * float(HEIGHT + GAP)
    boxed = rows.withColumns({"x0": F.lit(float(LEFT)), "y0": top, "x1": F.lit(float(LEFT)) + F.length("text") * float(GLYPH), "y1": top + float(HEIGHT), "confidence": F.lit(CONFIDENCE)})
    return boxed.where(F.trim("text") != "")


def _placed(pieces: Column) -> Column:
    """array<struct<t, start, word_index>>: the words among the pieces of a line, and where they stand.

    Lengths are added up in blocks, and the blocks' sums before them: a list that grows by one is copied, and a line may be long.
    """
    item = "array<struct<t:string,start:int,word_index:int>>"
    is_word = lambda w: (F.trim(w) != "") & ~w.rlike(f"^{SPACE}+$")
    block = lambda ps, i: F.slice(ps, i * BLOCK + 1, F.lit(BLOCK))

    def within(ps: Column, at: Column) -> Column:
        begin = F.struct(at["start"].alias("start"), at["n"].alias("n"), F.array().cast(item).alias("out"))
        word = lambda s, p: F.struct(p["t"].alias("t"), s["start"].alias("start"), s["n"].alias("word_index"))
        step = lambda s, p: F.struct((s["start"] + F.length(p["t"])).alias("start"), (s["n"] + p["ok"].cast("int")).alias("n"), F.when(p["ok"], F.array_append(s["out"], word(s, p).cast(item[6:-1]))).otherwise(s["out"]).alias("out"))
        return F.aggregate(ps, begin, step, lambda s: s["out"])

    def over(ps: Column) -> Column:
        zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"))
        total = lambda i: F.aggregate(block(ps, i), zero, lambda s, p: F.struct((s["start"] + F.length(p["t"])).alias("start"), (s["n"] + p["ok"].cast("int")).alias("n")))
        more = lambda out, x: F.array_append(out, bound(F.element_at(out, -1), lambda last: F.struct((last["start"] + x["start"]).alias("start"), (last["n"] + x["n"]).alias("n"))))
        begins = lambda blocks: F.aggregate(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), total), F.array(zero), more)
        return bound(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / BLOCK).cast("int")), lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), lambda i, at: within(block(ps, i), at))))

    return bound(F.transform(pieces, lambda w: F.struct(w.alias("t"), is_word(w).alias("ok"))), over)


def words_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Words of lines, their boxes in proportion to their characters; ``start`` is a word's place in its line. Nothing is shuffled."""
    solid = SPACE.replace("[", "[^", 1)
    pieces = F.split(F.col("text"), f"(?<={SPACE})(?={solid})|(?<={solid})(?={SPACE})", -1)
    placed = lines.select(*keys, "line_index", "confidence", F.length("text").alias("_n"), *[F.col(c).alias(f"_{c}") for c in BOX], F.explode(_placed(pieces)).alias("_p"))
    start, text = F.col("_p.start"), F.col("_p.t")
    x = lambda at: F.col("_x0") + (F.col("_x1") - F.col("_x0")) * at / F.col("_n")
    return placed.select(*keys, "line_index", F.col("_p.word_index").alias("word_index"), text.alias("text"), start.alias("start"), x(start).alias("x0"), F.col("_y0").alias("y0"), x(start + F.length(text)).alias("x1"), F.col("_y1").alias("y1"), "confidence")


def adjacent(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether word b follows word a closely on the same line."""
    ha, hb = a["y1"] - a["y0"], b["y1"] - b["y0"]
    height = F.greatest(ha, hb, F.lit(1.0))
    gap = b["x0"] - a["x1"]
    level = F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2) <= F.greatest(F.lit(5.0), height * 0.6)
    return level & (gap >= -height * 0.2) & (gap <= F.greatest(F.lit(20.0), height * 2.2))


def visual_line(words: DataFrame) -> DataFrame:
    """``words`` with ``visual_key``: a bucket of their middle, for words without a line of their own."""
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    return words.withColumn("visual_key", F.concat(F.lit("visual-"), F.round((F.col("y0") + F.col("y1")) / 2 / F.greatest(F.lit(6.0), height * 0.6)).cast("long").cast("string")))


def candidates(words: DataFrame, keys: list[str], most: int = 12, mark=None) -> DataFrame:
    """All runs of 1..``most`` adjacent words: keys, line_index, first_word, n_words, text (glued), spaced, box, confidence.

    A break counter makes runs comparable without a self-join: a window collects at most ``most`` following words. With ``mark`` runs have a column
    ``mark``: ``mark(glued, spaced)`` of the longest run that begins at their first word, worked out once for all of these.
    """
    line = Window.partitionBy(*keys, "line_index").orderBy("x0", "word_index")
    last = {c: F.lag(c).over(line) for c in BOX}
    here = {c: F.col(c) for c in BOX}
    broken = words.withColumn("_break", F.when(last["x0"].isNull() | ~adjacent(last, here), 1).otherwise(0))
    runs = broken.withColumn("_run", F.sum("_break").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = F.collect_list(F.struct("_run", F.trim("text").alias("t"), *BOX, "confidence")).over(line.rowsBetween(0, most - 1))
    rows = runs.withColumn("_next", ahead)
    own = F.filter("_next", lambda w: w["_run"] == F.col("_run"))
    rows, marks = rows.withColumn("_own", own), ["mark"] if mark else []
    if mark:
        glyphs = F.transform("_own", lambda w: w["t"])
        longest = bound(glyphs, lambda t: F.struct(F.array_join(t, "").alias("g"), F.array_join(t, " ").alias("s")))
        rows = rows.withColumn("_longest", longest).withColumn("mark", mark(F.col("_longest.g"), F.col("_longest.s")))
    sized = rows.select(*keys, "line_index", F.col("word_index").alias("first_word"), "_own", *marks, F.explode(F.sequence(F.lit(1), F.size("_own"))).alias("n_words"))
    part = F.slice("_own", F.lit(1), F.col("n_words"))
    pick = lambda c: F.transform(part, lambda w: w[c])
    made = sized.select(*keys, "line_index", "first_word", "n_words", *marks, F.array_join(pick("t"), "").alias("text"), F.array_join(pick("t"), " ").alias("spaced"), F.array_min(pick("x0")).alias("x0"), F.array_min(pick("y0")).alias("y0"), F.array_max(pick("x1")).alias("x1"), F.array_max(pick("y1")).alias("y1"), F.array_min(pick("confidence")).alias("confidence"))
    return made.where(F.col("text") != "")


def rolled(lines: DataFrame, page_col: str = "page", most: int = 2) -> DataFrame:
    """Laid-out lines (``lay_out``) with the first ``most`` of each page also below the page before, so that what wraps over its end is seen."""
    place = F.col("line_index") % PAGE_LINES
    both = F.when((place < most) & (F.col(page_col) > 1), F.array(F.col(page_col), F.col(page_col) - 1)).otherwise(F.array(F.col(page_col)))
    rows = lines.withColumn("_p", F.explode(both))
    down = F.when(F.col("_p") < F.col(page_col), float(PAGE_LINES * (HEIGHT + GAP))).otherwise(0.0)
    return rows.withColumns({"y0": F.col("y0") + down, "y1": F.col("y1") + down, page_col: F.col("_p")}).drop("_p")


def that_hold(lines: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """The lines of pages of which some line passes ``test``: windows then run over few pages."""
    return meet(lines, lines.where(test).select(*keys).distinct(), keys, "left_semi") if keys else lines


def wraps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with ``wraps``: whether the next line may continue this one.

    Not after a sentence's end; close below; and aligned on the left, or this line reaches the block's right edge.
    """
    page = Window.partitionBy(*keys)
    order = page.orderBy("line_index")
    nxt = {c: F.lead(c).over(order) for c in BOX}
    rows = lines.withColumns({f"_n_{c}": v for c, v in nxt.items()} | {"_right": F.max("x1").over(page)})
    height = F.greatest(F.col("y1") - F.col("y0"), F.col("_n_y1") - F.col("_n_y0"), F.lit(1.0))
    gap = F.col("_n_y0") - F.col("y1")
    level = (gap >= -height * 0.35) & (gap <= height * 1.5)
    left = F.abs(F.col("_n_x0") - F.col("x0")) <= F.greatest(F.lit(12.0), height * 1.2)
    right = F.col("x1") >= F.col("_right") - F.greatest(F.lit(24.0), height * 2.5)
    ok = ~F.trim("text").rlike("[.!?:]$") & level & (left | right)
    return rows.withColumn("wraps", F.coalesce(ok, F.lit(False))).drop(*[f"_n_{c}" for c in BOX], "_right")


def wrapped_windows(lines: DataFrame, keys: list[str], most_lines: int = 3) -> DataFrame:
    """keys, line_index, n_lines, texts (array) and text (joined by blanks): the longest chain of 2..``most_lines`` from each line."""
    order = Window.partitionBy(*keys).orderBy("line_index")
    rows = wraps(lines, keys).withColumn("text", F.array_join(F.filter(F.split("text", f"{SPACE}+"), lambda w: w != ""), " "))
    rows = rows.withColumns({f"_t{k}": F.lead("text", k).over(order) for k in range(1, most_lines)} | {f"_i{k}": F.lead("line_index", k).over(order) for k in range(1, most_lines)} | {f"_w{k}": F.lead("wraps", k).over(order) for k in range(1, most_lines - 1)})
    n = F.lit(most_lines)
    for k in range(most_lines - 1, 0, -1):
        n = F.when(F.col("wraps" if k == 1 else f"_w{k - 1}") & F.col(f"_t{k}").isNotNull(), n).otherwise(k)
    texts = F.slice(F.array("text", *[f"_t{k}" for k in range(1, most_lines)]), F.lit(1), F.col("n_lines"))
    indexes = F.slice(F.array("line_index", *[f"_i{k}" for k in range(1, most_lines)]), F.lit(1), F.col("n_lines"))
    chained = rows.withColumn("n_lines", n).where("n_lines >= 2")
    return chained.select(*keys, "line_index", "n_lines", indexes.alias("line_indexes"), texts.alias("texts")).withColumn("text", F.array_join("texts", " "))


def wrapped_ibans(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_index, text, compact, parts: account numbers that end on the next line, with a sound structure once joined.

    ``parts`` are the pieces: array<struct<line_index, span>>.
    """
    pairs = wrapped_windows(lines, keys, 2).select(*keys, "line_index", "line_indexes", F.get("texts", 0).alias("a"), F.get("texts", 1).alias("b"))
    head = F.regexp_extract("a", r"([A-Za-z]{2}[0-9]{2}(?:[ -]*[A-Za-z0-9]+)*) *$", 1)
    tail = F.regexp_extract("b", r"^([0-9][0-9A-Za-z -]*)", 1)
    rows = pairs.withColumns({"head": head, "tail": tail}).where("head <> '' and tail <> ''").withColumn("_c", T.compact_iban(F.col("head")))
    rows = rows.withColumn("_left", checks.iban_country_length(F.substring("_c", 1, 2)) - F.length("_c")).where((F.col("_left") > 0) & F.col("_c").rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]*$"))
    # As many characters as the country still lacks, with the blanks between them.
    shown = F.aggregate(F.split("tail", ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), lambda s, c: F.when((s["n"] >= F.col("_left")) | (c == ""), s).when(c.isin(" ", "-"), F.struct(s["n"].alias("n"), F.concat(s["s"], c).alias("s"))).otherwise(F.struct((s["n"] + 1).alias("n"), F.concat(s["s"], c).alias("s"))), lambda s: F.trim(s["s"]))
    rows = rows.withColumn("_s", shown).withColumn("compact", F.concat("_c", T.compact_iban(F.col("_s"))))
    return rows.where(checks.iban_structure(F.col("compact"))).select(*keys, "line_index", F.concat_ws(" ", F.trim("head"), "_s").alias("text"), "compact", F.arrays_zip(F.col("line_indexes").alias("line_index"), F.array(F.trim("head"), "_s").alias("span")).alias("parts"))


def without_iban_heads(detections: DataFrame, wrapped: DataFrame, keys: list[str]) -> DataFrame:
    """``detections`` less account numbers that are the beginning of a wrapped one on their page."""
    joined = wrapped.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("compact").alias("_compact"))
    mine = T.compact_iban(F.col("text"))
    match = (F.col("rule_id") == "iban") & (mine != F.col("_compact")) & F.startswith(F.col("_compact"), mine)
    return detections.join(joined, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], match], "left_anti")


def wrapped_bearer_tokens(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_index, text, span: one row for each line of a bearer token that continues on the next."""
    pairs = wrapped_windows(lines, keys, 2).select(*keys, "line_indexes", F.get("texts", 0).alias("a"), F.get("texts", 1).alias("b"))
    head, tail = spelled(r"(?i)\bBearer(?: +([A-Za-z0-9._~+/=-]+))? *$"), spelled(r"^([A-Za-z0-9._~+/=-]{4,})(?: *$|\b)")
    rows = pairs.where(F.col("a").rlike(head) & F.col("b").rlike(tail) & ~F.col("a").rlike(spelled(fixed.BEARER)))
    rows = rows.withColumns({"_h": F.regexp_extract("a", head, 1), "_t": F.regexp_extract("b", tail, 1)}).where(F.length(F.concat("_h", "_t")) >= 16)
    text = F.concat(F.lit("Bearer "), "_h", "_t")
    both = F.arrays_zip(F.col("line_indexes").alias("line_index"), F.array(F.rtrim(F.concat(F.lit("Bearer "), "_h")), "_t").alias("span"))
    return rows.select(*keys, text.alias("text"), F.explode(both).alias("_f")).select(*keys, "_f.line_index", "text", "_f.span")


def seed_phrases(texts: DataFrame, keys: list[str], wordlist: DataFrame, text_col: str = "text") -> DataFrame:
    """keys, text, start_word: the first run of 24, else 12, list words in each row that reads like no prose.

    ``wordlist`` (word) is the official list, 2048 rows by definition, and is joined by broadcast.
    """
    tokens = texts.select(*keys, F.posexplode(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+"), lambda w: w != "")).alias("at", "word"))
    known = tokens.join(F.broadcast(wordlist.select("word").distinct().withColumn("_in", F.lit(1))), "word", "left")
    stop = F.col("word").isin(fixed.SEED_STOPWORDS).cast("int")
    order = Window.partitionBy(*keys).orderBy("at")
    found = None
    for n in (24, 12):
        span = order.rowsBetween(0, n - 1)
        rows = known.withColumns({"_all": F.sum("_in").over(span), "_stop": F.sum(stop).over(span), "_len": F.avg(F.length("word")).over(span), "_words": F.collect_list("word").over(span)})
        good = (F.col("_all") == n) & (F.col("_len") >= 3) & (F.col("_stop") <= int(n * 0.35)) & (F.size(F.array_distinct("_words")) >= -(-n * 3 // 4)) & (F.size("_words") == n)
        hit = rows.where(good).select(*keys, F.lit(n).alias("n"), F.col("at").alias("start_word"), F.array_join("_words", " ").alias("text"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "start_word", "text")).alias("_b")).select(*keys, "_b.text", "_b.start_word")


def seed_phrase_lines(lines: DataFrame, keys: list[str], wordlist: DataFrame, most_lines: int = 3) -> DataFrame:
    """keys, line_index, text, span: seed phrases within a line or over up to ``most_lines`` that read on, one row for each line they touch.

    A phrase within one line is left to that line, even where a chain of lines holds it too.
    """
    single = seed_phrases(lines, [*keys, "line_index"], wordlist).select(*keys, "line_index", "text", F.col("text").alias("span"))
    chains = wrapped_windows(lines, keys, most_lines)
    found = seed_phrases(chains, [*keys, "line_index"], wordlist)
    found = meet(found, chains.select(*keys, "line_index", "line_indexes", "texts"), [*keys, "line_index"])
    # Words of the chain with their lines, cut to the phrase's own.
    own = F.flatten(F.zip_with("line_indexes", "texts", lambda i, t: F.transform(F.split(t, " "), lambda w: F.struct(i.alias("line_index"), w.alias("w")))))
    taken = found.withColumn("_w", F.slice(own, F.col("start_word") + 1, F.size(F.split("text", " ")))).withColumn("_i", F.array_distinct(F.transform("_w", lambda w: w["line_index"]))).where(F.size("_i") >= 2)
    each = taken.select(*keys, "text", "_w", F.explode("_i").alias("_line"))
    over = each.select(*keys, F.col("_line").alias("line_index"), "text", F.array_join(F.transform(F.filter("_w", lambda w: w["line_index"] == F.col("_line")), lambda w: w["w"]), " ").alias("span"))
    return single.unionByName(over.distinct())


def private_keys(lines: DataFrame, keys: list[str], carry: tuple = ()) -> DataFrame:
    """keys, line_index, text, span, start, block and columns to ``carry``: one row for each line of a private key.

    A key goes from its header to the next end line, or over 40 lines where there is none. On pages without a readable header, a line
    with a word of one and two lines of key body or more right below is a damaged key, up to its end line. Keys that begin on one page
    and end on the next are found whole where ``keys`` name the text: windows are two pages long, and no text is sorted whole.
    """
    t = F.col("text")
    header = F.regexp_extract("text", spelled(fixed.KEY_HEADER), 0)
    head = F.contains(t, F.lit("---")) & (header != "") & ~checks.public_pem(header)
    # Three classes in a row are tried faster than alternatives without case, and leave few lines to these.
    broken = t.rlike("[bBpPkK][eErR][gG6iI1lLyY]") & t.rlike("(?i)be[g6]|pr[i1l]|key") & checks.broken_key_header(t)
    dashes = F.contains(t, F.lit("---"))
    carried = [f"_c_{c}" for c in carry]
    marked = lines.select(*keys, "line_index", "text", *[F.col(c).alias(f"_c_{c}") for c in carry], F.floor(F.col("line_index") / PAGE_LINES).alias("_block"))
    # A window is a page's worth of lines and as many after it; only windows that may hold a key are laid out, and only their lines are looked at in full.
    may = marked.where(head | broken).groupBy(*keys, "_block").agg(F.max(head).alias("_page"), F.max(broken).alias("_b")).where("_page or _b")
    asked = may.select(*keys, "_page", F.col("_block").alias("_window"), F.explode(F.array("_block", F.col("_block") + 1)).alias("_block"))
    marks = {"_head": head, "_broken": broken, "_end": dashes & t.rlike(spelled(r"(?i)-{3,6}\s*END")), "_body": checks.base64_line(t)}
    own, keys = keys, [*keys, "_window"]
    page = Window.partitionBy(*keys)
    order = page.orderBy("line_index")
    rows = meet(marked, asked, [*own, "_block"]).withColumns(marks).withColumn("_row", F.row_number().over(order))
    following = F.min(F.when(F.col("_end"), F.col("_row"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_last", F.when(F.col("_head"), F.coalesce(following, F.col("_row") + fixed.KEY_LINES)))
    rows = rows.withColumns({"_reach": F.max("_last").over(upto), "_earlier": F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_island": F.sum((~F.col("_body")).cast("int")).over(upto)})
    top = F.max(F.when(~F.col("_body"), F.struct("_row", "_broken"))).over(upto)
    rows = rows.withColumns({"_top": top, "_n": F.sum(F.col("_body").cast("int")).over(Window.partitionBy(*keys, "_island"))})
    damaged = ~F.col("_page") & F.coalesce(F.col("_top._broken"), F.lit(False)) & (F.col("_n") >= 2) & (F.col("_row") - F.col("_top._row") <= fixed.KEY_LINES)
    rows = rows.withColumn("_damaged", damaged)
    closing = F.col("_end") & F.coalesce(F.lag("_damaged").over(order), F.lit(False)) & ~F.col("_page")
    rows = rows.withColumns({"_first": (F.col("_head") & (F.col("_row") > F.coalesce("_earlier", F.lit(0)))) | (F.col("_damaged") & ~F.col("_body")), "_in": (F.col("_page") & (F.col("_row") <= F.coalesce("_reach", F.lit(0)))) | F.col("_damaged") | closing})
    rows = rows.withColumn("block", F.sum(F.col("_first").cast("int")).over(upto)).where("_in")
    # A header may stand behind other text, an end line before some; the lines between are covered whole.
    begin = F.when(F.col("_head") & F.col("_first"), F.instr("text", header) - 1).otherwise(F.length("text") - F.length(F.ltrim("text")))
    span = F.regexp_extract(F.expr("substring(text, start + 1)"), spelled(rf"(?is)^(?:.*?{fixed.KEY_END}|.*(?<!\s))"), 0)
    # Of a key that two windows show, each line is returned once; a key is named by its first line.
    found = rows.withColumn("start", begin.cast("int")).withColumn("span", span).where("span <> ''")
    found = found.withColumn("block", F.min("line_index").over(Window.partitionBy(*keys, "block")))
    return found.groupBy(*own, "line_index", "span", "start", *carried).agg(F.min("block").alias("block")).select(*own, "line_index", F.col("span").alias("text"), "span", "start", "block", *[F.col(f"_c_{c}").alias(c) for c in carry])


def private_key_detections(lines: DataFrame, keys: list[str], carry: tuple = ()) -> DataFrame:
    """The rows of ``private_keys`` in the columns of ``detectors.detect``, with columns to ``carry``."""
    from maskwright.functions import detectors

    found = private_keys(lines, keys, carry)
    none, no = F.lit(None).cast("string"), F.lit(False)
    given = {"type": F.lit("private_key"), "rule_id": none, "label": F.lit(fixed.LABELS["private_key"]), "occurrence": F.lit(0), "listed": F.lit(True), "key": none, "needs_review": no, "hint": none}
    return found.select(*keys, "line_index", "text", "span", "start", *[v.alias(k) for k, v in given.items()], *[no.alias(h) for h in ("labeled", "ocr_corrected", "carrier_skipped", "iban_checksum_valid", "iban_checksum_failed")], *carry)


def detect_lines(lines: DataFrame, keys: list[str], **options) -> DataFrame:
    """``detectors.detect`` over the lines of texts or pages (keys, line_index, text), with private keys found over line ends."""
    from maskwright.functions import detectors

    found = detectors.detect(lines, [*keys, "line_index"], **options)
    only = options.get("only")
    if only is not None and "private_key" not in only:
        return found
    over = private_key_detections(lines, keys, tuple(options.get("carry", ())))
    return found.where("type <> 'private_key'").unionByName(over)


def place_on_line(detections: DataFrame, text_col: str) -> DataFrame:
    """Detections that carry their line (``text_col``, x0..y1) with the box of the words that each touches instead of the line's.

    Words of a laid-out line have boxes in proportion to their characters, so their union follows from the place alone: no join.
    """
    line, start, n = F.col(text_col), F.col("start"), F.length(text_col)
    before, after = F.substring(line, F.lit(1), start), F.expr(f"substring(`{text_col}`, start + length(span) + 1)")
    solid = SPACE.replace("[", "[^", 1)
    first = start - F.length(F.regexp_extract(before, f"({solid}*)$", 1))
    last = start + F.length("span") + F.length(F.regexp_extract(after, f"^({solid}*)", 1))
    x = lambda at: F.col("x0") + (F.col("x1") - F.col("x0")) * at / n
    return detections.where(start.isNotNull()).withColumns({"_x0": x(first), "_x1": x(last)}).drop("x0", "x1").withColumnsRenamed({"_x0": "x0", "_x1": "x1"})


def token_piece(text: Column) -> Column:
    """Whether a word may be the tail of a token that was cut: short, or with a digit or a sign that prose lacks."""
    t = F.trim(text)
    shape = t.rlike(r"^[A-Za-z0-9+/_=:#@~-]+$") & (F.length(t) <= PIECE_LENGTH)
    return shape & ((F.length(t) <= SHORT_PIECE) | t.rlike("[0-9+/=@:#]"))


def with_runs(words: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` with ``_place``, their order on the line, and ``_run``: pieces that stand as close as those of one cut token share it."""
    by_x = Window.partitionBy(*keys, "line_index").orderBy("x0", "y0", "word_index")
    glyph = (F.lag("x1").over(by_x) - F.lag("x0").over(by_x)) / F.greatest(F.length(F.lag("text").over(by_x)), F.lit(1))
    close = F.col("x0") - F.lag("x1").over(by_x) <= glyph * GLYPHS_APART + PIXELS_APART
    rows = words.withColumns({"_place": F.row_number().over(by_x), "_cut": (~F.coalesce(close & token_piece(F.col("text")), F.lit(False))).cast("int")})
    return rows.withColumn("_run", F.sum("_cut").over(by_x.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def place(detections: DataFrame, words: DataFrame, keys: list[str], grow: bool = False) -> DataFrame:
    """``detections`` (with line_index, start, span) and the union box of the words that each touches; unplaced ones go.

    With ``grow``, values of types that scanners cut take along the pieces that stand close after their last word.
    """
    on = [*keys, "line_index"]
    ids = detections.withColumn("_id", F.monotonically_increasing_id()) if "id" not in detections.columns else detections.withColumn("_id", F.col("id"))
    named = words.select(*on, F.col("start").alias("_s"), (F.col("start") + F.length("text")).alias("_e"), *[F.col(c).alias(f"_{c}") for c in BOX], F.col("confidence").alias("_confidence"))
    if grow:
        ahead = Window.partitionBy(*on, "_run").orderBy("_place").rowsBetween(1, MOST_PIECES)
        runs = with_runs(words, keys).withColumns({"_ax0": F.min("x0").over(ahead), "_ay0": F.min("y0").over(ahead), "_ax1": F.max("x1").over(ahead), "_ay1": F.max("y1").over(ahead)})
        named = runs.select(*on, F.col("start").alias("_s"), (F.col("start") + F.length("text")).alias("_e"), *[F.col(c).alias(f"_{c}") for c in BOX], F.col("confidence").alias("_confidence"), F.struct("_ax0", "_ay0", "_ax1", "_ay1").alias("_ahead"))
    met = meet(ids, named, on).where((F.col("_s") < F.col("start") + F.length("span")) & (F.col("_e") > F.col("start")))
    own = [c for c in ids.columns if c not in ("_id", "confidence")]
    sides = [F.min("_x0").alias("x0"), F.min("_y0").alias("y0"), F.max("_x1").alias("x1"), F.max("_y1").alias("y1"), F.min("_confidence").alias("confidence")]
    if not grow:
        return met.groupBy("_id", *own).agg(*sides).drop("_id")
    found = met.groupBy("_id", *own).agg(*sides, F.max_by("_ahead", "_s").alias("_ahead")).drop("_id")
    cut = F.col("type").isin(fixed.CUT_TYPES)
    side = lambda c, pick: F.when(cut, pick(F.col(c), F.coalesce(F.col(f"_ahead._a{c}"), F.col(c)))).otherwise(F.col(c))
    return found.withColumns({"x0": side("x0", F.least), "y0": side("y0", F.least), "x1": side("x1", F.greatest), "y1": side("y1", F.greatest)}).drop("_ahead")


def fragments(words: DataFrame, keys: list[str]) -> DataFrame:
    """Addresses put together from scanned pieces: keys, line_index, text, box, confidence. Pieces join by a colon only where one is missing.

    Pieces are neighbours on their line, level and close. Of a run the longest beginning that is one address counts; where none is, the
    run goes on without its first piece.
    """
    line = Window.partitionBy(*keys, "line_index").orderBy("x0", "word_index")
    last = {c: F.lag(c).over(line) for c in BOX}
    height = F.greatest(last["y1"] - last["y0"], F.col("y1") - F.col("y0"), F.lit(1.0))
    level = F.abs((F.col("y0") + F.col("y1")) / 2 - (last["y0"] + last["y1"]) / 2) <= F.greatest(F.lit(5.0), height * 0.6)
    close = level & (F.col("x0") - last["x1"] >= -height * 0.2) & (F.col("x0") - last["x1"] <= F.greatest(F.lit(20.0), height * 2.2))
    ok = words.withColumns({"_ok": checks.ipv6_fragment(F.col("text")), "_near": F.coalesce(close, F.lit(False))})
    cut = (~F.col("_ok") | ~F.col("_near") | ~F.coalesce(F.lag("_ok").over(line), F.lit(False))).cast("int")
    runs = ok.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(line.rowsBetween(Window.unboundedPreceding, 0))).where("_ok")
    item = F.struct("x0", "word_index", F.trim("text").alias("t"), "y0", "x1", "y1", "confidence")
    listed = runs.groupBy(*keys, "line_index", "_run").agg(F.sort_array(F.collect_list(item)).alias("_l")).where(F.array_join(F.transform("_l", lambda w: w["t"]), "").rlike(":.*:"))
    join = lambda part: F.aggregate(part, F.lit(""), lambda s, x: F.when((s == "") | F.endswith(s, F.lit(":")) | F.startswith(x["t"], F.lit(":")), F.concat(s, x["t"])).otherwise(F.concat(s, F.lit(":"), x["t"])))
    kind = "array<struct<x0:double,word_index:int,t:string,y0:double,x1:double,y1:double,confidence:double>>"
    begin = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        rest = F.slice("_l", i, F.lit(18))  # eight groups with their colons apart, and a port
        sizes = F.reverse(F.sequence(F.lit(1), F.size(rest)))
        fits = F.get(F.filter(sizes, lambda n: checks.ipv6(join(F.slice(rest, F.lit(1), n)))), 0)
        hit = F.struct((i + fits).alias("next"), F.array_append(s["out"], F.slice(rest, F.lit(1), fits).cast(kind)).alias("out"))
        return F.when((i < s["next"]) | fits.isNull(), s).otherwise(hit)

    found = listed.select(*keys, "line_index", F.explode(F.aggregate(F.sequence(F.lit(1), F.size("_l")), begin, step, lambda s: s["out"])).alias("_w"))
    side = lambda c, f: f(F.transform("_w", lambda w: w[c])).alias(c)
    return found.select(*keys, "line_index", join(F.col("_w")).alias("text"), side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max), side("confidence", F.array_min))
