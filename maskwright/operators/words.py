"""Detections from scanned words: values that a scanner cut into pieces, rows of words, and values beside labels.

Tables are as in ``pages``; windows run within a line or a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import checks, detectors, fixed
from maskwright.functions import text as T
from maskwright.functions.patterns import NOT_SPACE, SPACE, spelled
from maskwright.operators.joins import meet
from maskwright.operators.pages import candidates
from maskwright.operators.spatial import BOX

# Labels that announce a value on the same line, and what the value looks like.
BESIDE = {
    "session_id": (r"(?i)session\s*id\s*:?\s*", r"(?i)(?:sess|session)[_-]*[a-z0-9_-]{6,}"),
    "api_token": (r"(?i)api\s*(?:token|key)\s*:?\s*", r"(?i)(?:api[_-]*(?:test|live)[_-]*[a-z0-9_-]{8,}|(?:sk|pk|rk)[_-]*(?:live|test)[_-]*[a-z0-9]{24,})"),
}
VALUE_WORDS = 8
# The grid on which candidates are one, the least confidence of an address, and the types sought over words that were cut.
GRID, LEAST_EMAIL = 4.0, 25
CUT_WORDS = ["email", "api_token", "tckn", "ssn", "routing_number", "phone", "credit_card", "ipv4", "person_name", "location", "session_id"]
# Without any of these a run holds none of their values: a sign or digits, a label's end, or two words that begin like names.
MAY_HOLD = r"[@0-9:_–-]|[A-ZÇĞİÖŞÜ][^ ]* +[A-ZÇĞİÖŞÜ]|(?i:\b(?:in|at)\b|ili|merkez|sehri|şehri)"


def may_be_grouped(text: Column) -> Column:
    """What the text of a line holds wherever ``grouped_secrets`` finds a value: the sign of an address, eleven digits or their likes, thirteen digits, or the glyphs of an account number."""
    glyph, card = "[0-9OoIl|SsBb]", f"[0-9](?:[{SPACE[1:-1]}-]*[0-9]){{12}}"
    iban = f"[A-Z0-9]{{2}}{SPACE}*[0-9]{{2}}(?:{SPACE}*[A-Z0-9]){{13}}"
    return F.contains(text, F.lit("@")) | text.rlike(f"{glyph}(?:{SPACE}*{glyph}){{10}}") | (text.rlike("[0-9]") & (text.rlike(card) | text.rlike(iban)))


def may_hold_phones(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of pages on which ``phones_in_rows`` may find a number: those with a digit and ten in all, of which letters O that stand alone may be some."""
    alone = f"[OoΟοОоØø](?<!{NOT_SPACE}.)(?!{NOT_SPACE})"
    n = F.length("text") - F.length(F.regexp_replace("text", f"[0-9]|{alone}", ""))
    few = lines.groupBy(*keys).agg(F.sum(n).alias("_n"), F.max(F.col("text").rlike("[0-9]")).alias("_d")).where("_n >= 10 and _d").select(*keys)
    return meet(lines, few, keys, "left_semi")


def may_be_beside(text: Column) -> Column:
    """Whether the words of a line may hold a label of ``values_beside_labels``: both have their letters, whatever blanks stand between."""
    return text.rlike(spelled(r"(?i)session\s*id|api\s*(?:token|key)"))


def grouped_secrets(words: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """keys, line_index, first_word, n_words, type, rule_id, text, box: runs of adjacent words that are one value as a whole.

    An account number, a card, an address or an identity number, in that order of preference; of runs that begin at the
    same word the longest stays, and none begins inside a longer one before it.
    """
    runs = candidates(words, keys, most)
    spaced, glued = F.col("spaced"), F.col("text")
    iban = spaced.rlike(f"^(?:{spelled(fixed.IBAN)}|{spelled(fixed.IBAN_DAMAGED)})$") & checks.iban_structure(spaced)
    card = spaced.rlike(f"^{fixed.CARD}$") & checks.luhn(spaced) & ~checks.repeated_digit(spaced)
    # Words beside an address that is whole by itself don't belong to it.
    email = glued.rlike(f"^{fixed.EMAIL}$") & ((F.col("n_words") == 1) | ~spaced.rlike(fixed.EMAIL))
    number = T.correct_digits(glued)
    tckn = spaced.rlike(r"^[0-9OoIl|SsBb ]+$") & number.rlike("^[0-9]{11}$") & checks.tckn(number)
    kind = F.when(iban, "custom_rule").when(card, "credit_card").when(email, "email").when(tckn, "tckn")
    found = runs.withColumn("type", kind).where("type is not null").withColumns({"rule_id": F.when(iban, "iban").when(tckn & ~card & ~email, "tckn"), "value": F.when(iban | card, spaced).when(email, glued).otherwise(number)})
    longest = Window.partitionBy(*keys, "line_index", "first_word").orderBy(F.desc("n_words"))
    line = Window.partitionBy(*keys, "line_index").orderBy("first_word").rowsBetween(Window.unboundedPreceding, -1)
    best = found.withColumn("_r", F.row_number().over(longest)).where("_r = 1").withColumn("_end", F.max(F.col("first_word") + F.col("n_words")).over(line))
    return best.where(F.col("_end").isNull() | (F.col("first_word") >= F.col("_end"))).select(*keys, "line_index", "first_word", "n_words", "type", "rule_id", F.col("value").alias("text"), *BOX, "confidence")


def rows_of_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` with ``row``: words of one line, or of lines whose middles lie close, belong together, transitively.

    Sorted by their middles, a new row begins where the step from one word to the next exceeds both words' tolerance.
    """
    middle, height = (F.col("y0") + F.col("y1")) / 2, F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    order = Window.partitionBy(*keys).orderBy("_mid", "line_index", "word_index")
    rows = words.withColumns({"_mid": middle, "_h": height})
    step = F.col("_mid") - F.lag("_mid").over(order)
    band = F.greatest(F.col("_h"), F.lag("_h").over(order))
    apart = F.coalesce((step > F.greatest(F.lit(10.0), band * 1.15)) & (F.col("line_index") != F.lag("line_index").over(order)), F.lit(False))
    cut = rows.withColumn("_cut", apart.cast("int"))
    return cut.withColumn("row", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_mid", "_h", "_cut")


def phones_in_rows(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, text, box, confidence, ocr_corrected: phone numbers over the words of a row, and the box of those they touch."""
    placed = rows_of_words(words, keys).withColumn("_t", F.when(F.trim("text").rlike("^[OoΟοОоØø]$"), "0").otherwise(F.trim("text")))
    order = Window.partitionBy(*keys, "row").orderBy("x0", "line_index", "word_index")
    placed = placed.withColumn("_end", F.sum(F.length("_t") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("_start", F.col("_end") - F.length("_t"))
    item = F.struct("_start", "_end", "_t", (F.col("_t") != F.trim("text")).alias("_c"), *BOX, "confidence")
    lines = placed.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(item)).alias("_w")).withColumn("_line", F.array_join(F.transform("_w", lambda w: w["_t"]), " "))
    hits = lines.where(F.col("_line").rlike("[0-9].{6,}[0-9]")).select(*keys, "row", "_w", F.explode(detectors.phone_hits(F.col("_line"), False)).alias("_p"))
    touched = F.filter("_w", lambda w: (w["_start"] < F.col("_p.start") + F.length("_p.raw")) & (w["_end"] > F.col("_p.start")))
    met = hits.withColumn("_m", touched)
    side = lambda c, f: f(F.transform("_m", lambda w: w[c])).alias(c)
    return met.select(*keys, "row", F.col("_p.raw").alias("text"), side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max), side("confidence", F.array_min), F.exists("_m", lambda w: w["_c"]).alias("ocr_corrected"))


def values_beside_labels(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_index, type, text: what follows a session or token label on its line, glued from eight words at most."""
    item = F.struct("x0", "word_index", F.trim("text").alias("t"), "x1", "y0", "y1")
    lines = words.groupBy(*keys, "line_index").agg(F.sort_array(F.collect_list(item)).alias("_w")).withColumn("_line", F.array_join(F.transform("_w", lambda w: w["t"]), " "))
    out = None
    for kind, (label, value) in BESIDE.items():
        # Words are counted up to the first at which the label is complete.
        upto = lambda n: F.concat(F.array_join(F.transform(F.slice("_w", F.lit(1), n), lambda w: w["t"]), " "), F.lit(" "))
        first = F.get(F.filter(F.sequence(F.lit(1), F.size("_w")), lambda n: upto(n).rlike(spelled(label))), 0)
        rows = lines.where(F.col("_line").rlike(spelled(label))).withColumn("_from", first).where(F.col("_from") < F.size("_w"))
        tail = F.slice("_w", F.col("_from") + 1, F.lit(VALUE_WORDS))
        height = lambda w: w["y1"] - w["y0"]
        close = lambda a, b: b["x0"] - a["x1"] <= F.greatest(F.lit(16.0), F.greatest(height(a), height(b)) * 1.5)
        start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("struct<x0:double,word_index:int,t:string,x1:double,y0:double,y1:double>").alias("last"), F.lit("").alias("s"))
        step = lambda a, w: F.when(a["on"] & (a["last"].isNull() | close(a["last"], w)), F.struct(F.lit(True).alias("on"), w.alias("last"), F.concat(a["s"], w["t"]).alias("s"))).otherwise(F.struct(F.lit(False).alias("on"), a["last"].alias("last"), a["s"].alias("s")))
        glued = T.normalize_credential(F.aggregate("_tail", start, step, lambda a: a["s"]))
        found = rows.withColumn("_tail", tail).withColumn("_v", F.regexp_extract(glued, value, 0)).where("_v <> ''")
        made = found.select(*keys, "line_index", F.lit(kind).alias("type"), (T.format_api_token(F.col("_v")) if kind == "api_token" else F.col("_v")).alias("text"))
        out = made if out is None else out.unionByName(made)
    return out


def second_pass_numbers(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, text: identity numbers in a second reading: as found, else in any window of a token of twelve or thirteen digits."""
    direct = detectors.detect(texts, keys, text_col, only=["tckn"]).select(*keys, "text").distinct()
    token = T.correct_digits(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+", ""))
    rest = texts.join(direct.select(*keys).distinct(), keys, "left_anti").withColumn("_t", token).where(F.col("_t").rlike("^[0-9]{12,13}$"))
    windows = rest.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.length("_t") - 10), lambda i: F.substring(F.col("_t"), i, F.lit(11)))).alias("text"))
    return direct.unionByName(windows.where(checks.tckn(F.col("text"))).distinct())


def batch_label(items: DataFrame, batch_keys: list[str], order_col: str) -> DataFrame:
    """keys, label: how far a batch (rows with status queued, processing, completed or failed) has come."""
    order = Window.partitionBy(*batch_keys).orderBy(order_col)
    rows = items.withColumn("_at", F.row_number().over(order))
    totals = rows.groupBy(*batch_keys).agg(F.count("*").alias("n"), F.min(F.when(F.col("status") == "processing", F.col("_at"))).alias("busy"), F.sum(F.col("status").isin("completed", "failed").cast("int")).alias("done"))
    text = lambda at: F.concat(F.lit("Processing image "), at.cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit("..."))
    label = F.when(F.col("busy").isNotNull(), text(F.col("busy"))).when(F.col("done") >= F.col("n"), F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " image ready").otherwise(" images ready"))).otherwise(text(F.col("done") + 1))
    return totals.select(*batch_keys, label.alias("label"))


def single_candidates(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``runs`` (``pages.candidates``) with one of those that read alike at one place: single words before runs, then in their order.

    Places are compared on a grid of four pixels, so a page is never sorted: a key is a text and a cell.
    """
    cell = lambda c: F.floor(c / GRID + 0.5)
    shown = T.detection_text(F.col("text"))
    place = [*keys, "_t", "_x", "_y", "_w"]
    rows = runs.withColumns({"_t": shown, "_x": cell(F.col("x0")), "_y": cell(F.col("y0")), "_w": cell(F.col("x1") - F.col("x0"))}).where("_t <> ''")
    order = Window.partitionBy(*place).orderBy(F.col("n_words") > 1, "line_index", "first_word", "n_words")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_t", "_x", "_y", "_w", "_r")


def detect_candidates(words: DataFrame, keys: list[str], only: list[str] | None = None, most: int = 12) -> DataFrame:
    """keys, line_index, first_word, n_words, type, text, box, confidence and hint: values that adjacent words hold together, glued or apart.

    Every run of words is read twice, glued and with blanks; tokens only with blanks, and addresses glued only where no shorter one stands there
    with blanks. Of runs that give one value the shortest ones stay; of values of one type that share words the longest stay, the first first.
    A value needs a look only if it does in every run that gives it. What types a run may hold is asked once for all that begin at its first word. Words that
    are dealt by their keys already are not shuffled again.
    """
    types = [t for t in CUT_WORDS if only is None or t in only]
    begin = lambda t: detectors.may_begin(t, F.lower(t), T.fold_turkish(t), types)
    runs = single_candidates(candidates(words, keys, most, lambda glued, spaced: begin(glued).bitwiseOR(begin(spaced))).where("mark <> 0"), keys)
    at = [*keys, "line_index", "first_word", "n_words"]
    read = runs.select(*at, *BOX, "confidence", "mark", F.explode(F.array_distinct(F.array(F.struct(F.lit(True).alias("apart"), F.col("spaced").alias("reading")), F.struct((F.col("spaced") == F.col("text")).alias("apart"), F.col("text").alias("reading"))))).alias("_r"))
    # Tokens are read with blanks only.
    glued = F.col("mark").bitwiseAND(F.lit(~detectors.type_bits(["api_token"], types)))
    read = read.select(*at, *BOX, "confidence", "_r.apart", "_r.reading", F.when(F.col("_r.apart"), F.col("mark")).otherwise(glued).alias("mark"))
    read = read.where((F.col("mark") != 0) & F.col("reading").rlike(MAY_HOLD))
    found = detectors.detect(read, [*at, "apart"], "reading", rules=(), only=types, carry=("confidence", *BOX), may="mark", dealt=True).where("listed")
    found = found.where(F.col("apart") | (F.col("type") != "api_token")).where((F.col("type") != "email") | (F.col("confidence") >= LEAST_EMAIL))
    run = Window.partitionBy(*at, "type")
    held = F.collect_set(F.when(F.col("apart"), F.lower("text"))).over(run)
    longer = F.exists("_apart", lambda s: F.startswith(F.lower("text"), s) & (F.length("text") > F.length(s)))
    found = found.withColumn("_apart", held).where((F.col("type") != "email") | F.col("apart") | ~longer)
    # One row a value and run; then the shortest runs of each value of a line.
    value = [*keys, "line_index", "type", "text"]
    single = found.groupBy(*at, "type", "text").agg(F.min("hint").alias("hint"), F.max(F.col("hint").isNull()).alias("_sure"), *[F.first(c).alias(c) for c in (*BOX, "confidence")])
    all_runs = Window.partitionBy(*value)
    end = F.col("first_word") + F.col("n_words")
    listed = single.withColumns({"_runs": F.collect_set(F.struct(F.col("first_word").alias("a"), end.alias("b"))).over(all_runs), "_sure": F.max("_sure").over(all_runs)})
    within = F.exists("_runs", lambda r: (r["a"] >= F.col("first_word")) & (r["b"] <= end) & (r["b"] - r["a"] < F.col("n_words")))
    shortest = listed.where(~within).withColumn("hint", F.when(~F.col("_sure"), F.col("hint")))
    # Values of one type that share words: a fold over the line's, longest text first.
    item = F.struct((-F.length("text")).alias("size"), "first_word", "n_words", "text", "hint", *BOX, "confidence")
    lines = shortest.groupBy(*keys, "line_index", "type").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    apart = lambda k, x: (k["first_word"] + k["n_words"] <= x["first_word"]) | (x["first_word"] + x["n_words"] <= k["first_word"])
    chosen = F.aggregate("_all", F.slice("_all", 1, 0), lambda out, x: F.when(F.forall(out, lambda k: apart(k, x)), F.array_append(out, x)).otherwise(out))
    kept = lines.select(*keys, "line_index", "type", F.explode(chosen).alias("_d"))
    return kept.select(*keys, "line_index", "_d.first_word", "_d.n_words", "type", "_d.text", *[f"_d.{c}" for c in BOX], "_d.confidence", "_d.hint")
