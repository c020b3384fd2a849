"""Detectors: rows of text in, typed matches out, in one pass over the text and without Python.

``raw_hits`` collects every family's matches of a text in one array; ``detect`` explodes it and decides row by row.
Only matches are ever shuffled: for the order of equal values within a text and for the removal of repeats.
"""

from __future__ import annotations

import dataclasses
import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import checks, fixed
from maskwright.functions import text as T
from maskwright.functions.patterns import PLACE, SPACE, any_of, before, blanked, bound, digits, located, loose_occurrences, occurrences, spelled, squeeze
from maskwright.sources.tables import spread

HIT = "struct<family:string,start:int,raw:string,g1:string,g2:string,g3:string,g4:string>"
NONE = f"array<{HIT}>"
ONCE = ["email", "ipv4", "ipv6", "credit_card", "ssn", "routing_number", "vkn", "iban", "custom_rule", "connection_url", "api_token", "session_id", "private_key"]


@dataclasses.dataclass(frozen=True)
class Rule:
    """A user's rule: a keyword or a regular expression, found as matches of type custom_rule."""

    id: str
    label: str
    pattern: str
    ignore_case: bool = False
    enabled: bool = True

    @classmethod
    def of(cls, row: dict) -> Rule | None:
        """The rule that a settings row describes, cut to its limits; None where it can't be used."""
        kind, name = row.get("type"), str(row.get("name") or row.get("label") or "").strip()[:80]
        pattern = str(row.get("pattern") or "").strip()[:180]
        if kind not in ("keyword", "regex") or not name or len(pattern) < 2:
            return None
        if kind == "regex":
            try:
                re.compile(pattern)
            except re.error:
                return None
            if checks.unsafe_pattern(pattern):
                return None
        shown = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", pattern) if kind == "keyword" else pattern
        return cls(str(row.get("id") or name)[:40], name, shown, kind == "keyword", row.get("enabled") is not False)


SAMPLE_RULES = [Rule("custom-id", "Possible custom ID", fixed.CUSTOM_ID)]


def _hits(family: str, found: Column) -> Column:
    return F.transform(found, lambda h: F.struct(F.lit(family).alias("family"), h["start"].alias("start"), h["raw"].alias("raw"), *[h[f"g{k}"].alias(f"g{k}") for k in range(1, 5)]).cast(HIT))


def _texts(family: str, texts: Column) -> Column:
    """Hits whose place is looked up later, as their text isn't the source's."""
    none = F.lit(None).cast("string")
    return F.transform(texts, lambda t: F.struct(F.lit(family).alias("family"), F.lit(None).cast("int").alias("start"), t.alias("raw"), none.alias("g1"), none.alias("g2"), none.alias("g3"), none.alias("g4")).cast(HIT))


def _if(guard: Column, found: Column) -> Column:
    """``found`` only where a cheap test leaves it possible."""
    return F.when(guard, found).otherwise(F.array().cast(NONE))


def api_token_texts(text: Column) -> Column:
    return bound(F.regexp_replace(T.one_dash(text), spelled(r"(?i)\bapi\s+(test|live)\s+"), "api_$1_"), lambda joined: _token_texts(text, joined))


def _token_texts(text: Column, joined: Column) -> Column:
    every = [F.regexp_extract_all(joined, F.lit(spelled(p)), F.lit(0)) for p in fixed.API_TOKENS]
    kinds = lambda p: F.filter(F.regexp_extract_all(joined, F.lit(spelled(p)), F.lit(0)), lambda t: checks.mixed_kinds(t) & ~checks.log_identifier(t))
    # A long token may go on after one blank, where a scanner cut it: a short tail that is no word.
    tailed = spelled(rf"({fixed.LONG_TOKEN})(?: ([A-Za-z0-9+/_=:.-]{{1,12}})(?![A-Za-z0-9+/_=:.-]))?")
    pairs = F.zip_with(F.regexp_extract_all(joined, F.lit(tailed), F.lit(1)), F.regexp_extract_all(joined, F.lit(tailed), F.lit(2)), lambda t, e: F.struct(t.alias("t"), e.alias("e")))
    long = F.filter(pairs, lambda x: checks.mixed_kinds(x["t"]) & ~checks.log_identifier(x["t"]))
    tail = lambda e: ~F.contains(e, F.lit(".")) & ((F.length(e) <= 3) | e.rlike("[0-9+/=:]"))
    longs = F.transform(long, lambda x: F.concat(x["t"], F.when(tail(x["e"]), x["e"]).otherwise("")))
    found = F.concat(stripe_texts(text), *every, connection_urls(text), kinds(fixed.AWS_SECRET), longs)
    return F.filter(F.array_distinct(F.transform(found, T.format_api_token)), checks.api_token)


def stripe_texts(text: Column) -> Column:
    """Keys with a prefix, their bodies followed over blanks until an ordinary word."""
    joined = F.regexp_replace(T.one_dash(text), spelled(r"(?i)\b(sk|pk|rk)\s+(live|test)\b"), "$1_$2_")
    shape = spelled(r"\b((?i:(?:sk|pk|rk)_(?:live|test)_|(?:sk|pk|rk)(?:live|test)))([A-Za-z0-9]*+(?:\s++(?![a-z]{3,}(?![A-Za-z0-9]))[A-Za-z0-9]++)*)")
    pairs = bound(joined, lambda j: F.zip_with(F.regexp_extract_all(j, F.lit(shape), F.lit(1)), F.regexp_extract_all(j, F.lit(shape), F.lit(2)), lambda p, b: F.struct(p.alias("p"), F.regexp_replace(b, f"{SPACE}+", "").alias("b"))))
    kept = F.filter(pairs, lambda x: (F.length(x["b"]) >= 8) & ((F.length(x["b"]) >= 24) | x["b"].rlike("[0-9]")))
    return F.transform(kept, lambda x: F.concat(F.when(F.contains(x["p"], F.lit("_")), x["p"]).otherwise(F.regexp_replace(F.lower(x["p"]), "^(..)(....)$", "$1_$2_")), x["b"]))


def connection_urls(text: Column) -> Column:
    """Database and broker addresses with user and password, scanner gaps closed."""
    found = F.regexp_extract_all(T.credential_search_text(text), F.lit(spelled(fixed.CONNECTION_URL)), F.lit(0))
    clean = F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, "\x00", ""), "[.,;!?)]+$", ""))
    return F.array_distinct(F.filter(clean, lambda u: u.rlike("://[^/@]+:[^/@]+@")))


def phone_hits(text: Column, blank_numbers: bool = True) -> Column:
    """Accepted phone numbers; where asked for, addresses and card-like runs don't count as digits."""
    if not blank_numbers:
        return bound(T.rewrite_trunk_o(text), _phones)
    # Blanks of equal length: positions are those of the text.
    address = rf"(?=[0-9])\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?::[0-9]{{1,5}})?\b"
    return bound(blanked(text, address), lambda rest: bound(blanked(rest, fixed.CARD), lambda bare: bound(T.rewrite_trunk_o(bare), _phones)))


def _phones(source: Column) -> Column:
    places = F.flatten(F.array(*[located(source, p) for p in fixed.PHONES]))
    trimmed = F.transform(places, lambda h: F.struct((h["start"] + F.length(h["raw"]) - F.length(F.ltrim(h["raw"]))).alias("start"), F.trim(h["raw"]).alias("text")))

    def accepted(h: Column, d: Column) -> Column:
        t = h["text"]
        turkish = t.rlike(r"^(?:\+90|0090)") | F.startswith(d, F.lit("0090")) | t.rlike("^0(?!0)") | d.rlike("^90(?!0)|^9[1-9]").__and__(F.startswith(d, F.lit("90")))
        local = t.rlike("^0(?!0)") & before(source, h["start"], 24).rlike(spelled(r"(?i)(?:^|[^a-z])(?:tel|telefon|phone)\s*:?\s*$"))
        return checks.phone_shape(t) & ~F.startswith(d, F.lit("000")) & (~turkish | local | checks.turkish_carrier(t))

    end = lambda h: h["start"] + F.length(h["text"])

    def longest(good: Column) -> Column:
        # Of matches over each other the longest stays; g1 marks those whose text is a part of a longer one elsewhere.
        kept = F.filter(good, lambda h: ~F.exists(good, lambda o: (o["start"] <= h["start"]) & (end(o) >= end(h)) & (F.length(o["text"]) > F.length(h["text"]))))
        part = lambda h: F.when(F.exists(good, lambda o: (o["text"] != h["text"]) & F.contains(o["text"], h["text"])), "part").otherwise("")
        return F.transform(kept, lambda h: F.struct(h["start"].alias("start"), h["text"].alias("raw"), part(h).alias("g1"), *[F.lit("").alias(f"g{k}") for k in (2, 3, 4)]))

    return bound(F.array_distinct(F.filter(trimmed, lambda h: bound(digits(h["text"]), lambda d: accepted(h, d)))), longest)


def _label_head(labels: list[str]) -> str:
    every = "|".join(x.replace(" ", r"\s+") for x in sorted(labels, key=len, reverse=True))
    return rf"(?:^|[^a-z0-9])(?:{every})(?![a-z0-9])\s*[:\-–]\s*"


def _place_guard(text: Column, folded: Column) -> Column:
    """Tests without which neither a labelled place nor a province in context can be found, the cheap ones first."""
    provinces = any_of(fixed.PROVINCES)
    labelled = rf"(?<![a-z0-9])(?:{any_of(fixed.PLACE_LABELS).replace(' ', spelled(chr(92) + 's') + '+')}|{fixed.PLACE_CONTEXT_LABELS})(?![a-z0-9])\s*[:\-–]"
    # A character before a word is cheaper to ask for than that there be none of a class: the text gets a blank in front.
    before, after = rf"[^a-z0-9](?:in|at)\s+(?:{provinces})", rf"[^a-z0-9](?:{provinces})\s+(?:ili|merkez|sehri)"
    ending = _any([F.contains(folded, F.lit(w)) for w in ("ili", "merkez", "sehri")])
    spaced = F.concat(F.lit(" "), folded)
    return (_any([F.contains(text, F.lit(c)) for c in ":-–"]) & folded.rlike(spelled(labelled))) | spaced.rlike(spelled(before)) | (ending & spaced.rlike(spelled(after)))


def _dashed(text: Column) -> Column:
    """Whether a dash or underscore of any kind stands in the text; only texts with characters so far up are asked for those beyond ASCII."""
    far = (F.octet_length(text) != F.length(text)) & text.rlike(r"[\u2010-\uffff]") & text.rlike("[‐-―−＿﹍﹎]")
    return F.contains(text, F.lit("-")) | F.contains(text, F.lit("_")) | far


def _may_hold_token(text: Column, low: Column) -> Column:
    """A prefix of a known kind, or forty characters on end; blanks around dashes may be closed up first."""
    prefix = r"(?i)api[\s_-]*(?:test|live)|gh[pousr]\s*[_＿﹍﹎]|github|eyJ|[spr]k[\s_＿﹍﹎‐-―−-]*(?:live|test)|sk\s*[-‐-―−]|A(?:KIA|SIA|ROA|IDA)|://"
    # A part of each prefix, and a dash or underscore: what holds none of them is not searched.
    part = _any([F.contains(low, F.lit(w)) for w in ("live", "test", "github", "eyj", "akia", "asia", "aroa", "aida", "://")])
    end, prefixed = "[A-Za-z0-9+/_=-]", text.rlike(spelled(prefix))
    # Letters alone are two kinds of characters at most, and such a run is no token. Runs are tried at their beginnings.
    forty = lambda t: F.concat(F.lit(" "), t).rlike(f"{end.replace('[', '[^')}{end}{{40}}")
    plain = text.rlike("[0-9+/_=-]") & forty(text)
    return F.when(_dashed(text), prefixed | plain | forty(T.one_dash(text))).otherwise((part & prefixed) | plain)


def place_hits(text: Column, folded: Column) -> Column:
    labels = "|".join(x.replace(" ", r"\s+") for x in sorted(fixed.PLACE_LABELS, key=len, reverse=True))
    stop = rf"(?:^|[^a-z0-9])(?:{labels}|email|e-mail|phone|tel|name|customer|employee|ad\s+soyad|musteri)\s*[:\-–]"
    heads = located(folded, _label_head(fixed.PLACE_LABELS))

    def value(h: Column) -> Column:
        at = h["start"] + F.length(h["raw"])
        # Folding keeps lengths and white space, so both are squeezed alike.
        rest, low = (F.regexp_replace(F.substring(x, at + 1, F.length(x)), f"{SPACE}+", " ") for x in (text, folded))
        ends = F.length(F.get(F.split(low, spelled(stop), 2), 0))
        shown = bound(rest, lambda r: bound(ends, lambda cut: squeeze(F.regexp_replace(squeeze(F.when(cut > 0, F.substring(r, F.lit(1), cut)).otherwise(r)), "[,;:]+$", ""))))
        return bound(shown, place)

    def place(shown: Column) -> Column:
        fine = (shown != "") & (F.length(shown) <= 96) & (F.size(F.split(shown, " ")) <= 12) & ~T.fold_turkish(shown).isin(fixed.PLACE_REJECTS) & (shown.rlike("[A-Za-zÇĞİÖŞÜçğıöşü]") | F.replace(shown, F.lit(" "), F.lit("")).rlike("^[0-9]{4,10}$"))
        return F.when(fine, shown)

    labelled = F.filter(F.transform(heads, value), lambda v: v.isNotNull())
    near = F.filter(F.array(*map(F.lit, fixed.PROVINCES)), lambda p: F.contains(folded, p))
    edge = spelled(r"\b")

    def named(p: Column) -> Column:
        parts = [rf"{edge}(?:{fixed.PLACE_CONTEXT_LABELS}){edge}{SPACE}*[:\-–]{SPACE}*(?:[a-z0-9.'’/\s-]{{0,48}})?".replace(r"\s", SPACE), p, rf"{edge}|{edge}", p, rf"{SPACE}+(?:ili|ilinde|merkez|sehri|sehrinde){edge}|{edge}(?:in|at){SPACE}+", p, edge]
        pattern = F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
        start = F.length(F.get(F.split(folded, pattern, 2), 0))
        at = F.locate(p, folded, 1) if isinstance(p, str) else F.instr(F.substring(folded, start + 1, F.length(folded)), p) + start
        return F.when(F.regexp_like(folded, pattern), F.substring(text, at, F.length(p)))

    provinces = F.filter(F.transform(near, named), lambda v: v.isNotNull())
    return bound(F.array_distinct(F.concat(labelled, provinces)), lambda texts: F.filter(texts, lambda t: ~F.exists(texts, lambda o: (o != t) & F.contains(o, t))))


def labelled_names(text: Column, folded: Column) -> Column:
    """Up to three capitalised words after a name label."""
    heads = located(folded, _label_head(fixed.NAME_LABELS))
    letter = "A-Za-z0-9_"

    def name(h: Column) -> Column:
        rest = F.regexp_replace(F.substring(text, h["start"] + F.length(h["raw"]) + 1, F.length(text)), f"{SPACE}+", " ")
        word = rf"(?:{SPACE}*({fixed.CAPITAL_WORD})(?:(?<=[{letter}])(?![{letter}])|(?<![{letter}])(?=[{letter}])))"
        return bound(rest, lambda r: bound(taken([F.regexp_extract(r, f"^{word}{word}?{word}?", k) for k in (1, 2, 3)]), shown))

    def taken(got: list[Column]) -> Column:
        words = F.transform(F.filter(F.array(*got), lambda w: w != ""), T.strip_name_suffix)
        bad = lambda w: (F.length(w) < 2) | T.fold_turkish(w).isin(fixed.NAME_VALUE_STOPWORDS)
        # Words up to the first that is no name.
        return F.aggregate(words, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("w")), lambda a, w: F.when(a["on"] & ~bad(w), F.struct(F.lit(True).alias("on"), F.array_append(a["w"], w).alias("w"))).otherwise(F.struct(F.lit(False).alias("on"), a["w"].alias("w"))), lambda a: a["w"])

    def shown(words: Column) -> Column:
        return bound(F.array_join(words, " "), lambda t: F.when((F.size(words) > 0) & (F.length(t) <= 48) & ((F.size(words) > 1) | (F.length(t) >= 3)), t))

    return F.filter(F.transform(heads, name), lambda v: v.isNotNull())


def type_bits(types: list[str], among: list[str]) -> int:
    """``types`` as bits, by their places in ``among``."""
    return sum(1 << among.index(t) for t in types if t in among)


def raw_hits(text: Column, low: Column, folded: Column, rules: tuple[Rule, ...] = (), only: list[str] | None = None, may: Column | None = None) -> Column:
    """array<HIT>: what every family's pattern finds in a text, before acceptance; ``only`` limits the types.

    ``low`` and ``folded`` are the text in lower case and without Turkish marks. ``may``, if given, has the bits (``type_bits``) of those of ``only`` that
    this very text may hold: for the others not even the cheap tests are made.
    """
    has = lambda *words: _any([F.contains(low, F.lit(w)) for w in words])
    any_digit, nine_digits = text.rlike("[0-9]"), text.rlike("^(?:[^0-9]*+[0-9]){9}")
    word = lambda p: folded.rlike(spelled(p))
    titled = F.concat(F.lit(" "), folded).rlike(f"[^a-z](?:{any_of([*fixed.GIVEN_NAMES, *[T.plain(t) for t in fixed.TITLES.split('|')]])})(?![a-z])")
    key_block = rf"{fixed.KEY_HEADER}(?:[\x00-\x{{10ffff}}]*?{fixed.KEY_END}|[^\n]*(?:\n[^\n]*){{0,{fixed.KEY_LINES}}})"
    session = lambda: bound(T.normalize_credential(text), lambda t: F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(spelled(p)), F.lit(0)) for p in fixed.SESSIONS]))))
    # types, a cheap test that leaves them possible, and the search itself; tests that several share stand before all of them, and are made once
    open_to = lambda types: may.bitwiseAND(F.lit(type_bits(types, only))) != 0
    wanted = lambda families: [_if(test if may is None else open_to(types) & test, found()) for types, test, found in families if only is None or set(types) & set(only)]

    def behind(test: Column, families: list[Column]) -> list[Column]:
        return [_if(test, F.concat(*families) if len(families) > 1 else families[0])] if families else []

    if may is not None:
        nine_digits = open_to(["credit_card", "phone", "ssn", "routing_number", "custom_rule"]) & nine_digits
    long = wanted([
        (["credit_card"], F.lit(True), lambda: _hits("credit_card", located(text, fixed.CARD))),
        (["phone"], F.lit(True), lambda: _hits("phone", phone_hits(text))),
        (["ssn"], F.lit(True), lambda: _hits("ssn", located(text, fixed.SSN))),
        (["ssn", "routing_number"], F.lit(True), lambda: _hits("nine", located(text, fixed.NINE_DIGITS))),
        (["custom_rule"], text.rlike("[A-Z0-9]{2}[0-9]{2}"), lambda: _hits("iban", F.concat(located(text, fixed.IBAN), located(text, fixed.IBAN_DAMAGED)))),
    ])
    own = lambda held: [(["custom_rule"], text.rlike("[0-9]{4}") if held else F.lit(True), lambda r=r: _hits(f"rule:{r.id}", located(text, ("(?i)" if r.ignore_case else "") + r.pattern))) for r in rules if r.enabled and (r.pattern == fixed.CUSTOM_ID) == held]
    numbers = [
        *wanted([(["ipv4"], text.rlike(spelled(r"[0-9]\s*[.·•]\s*[0-9]")), lambda: _hits("ipv4", located(text, fixed.IPV4)))]),
        *behind(nine_digits, long),
        *wanted(own(True)),
    ]
    glyphs = wanted([
        (["tckn"], text.rlike("[0-9OoIl|SsBb]{11}"), lambda: _hits("tckn", located(text, fixed.TCKN))),
        (["vkn"], F.lit(True), lambda: _hits("vkn", located(text, fixed.VKN))),
    ])
    families = [
        (["email"], has("@"), lambda: _hits("email", located(text, fixed.EMAIL))),
        (["ipv6"], has(":") & text.rlike("(?i):[0-9a-f:]*:"), lambda: _hits("ipv6", located(text, fixed.IPV6))),
        (["api_token"], _may_hold_token(text, low), lambda: _texts("api_token", api_token_texts(text))),
        (["connection_url"], has("://"), lambda: _texts("connection_url", connection_urls(text))),
        (["bearer_token"], has("bearer"), lambda: _hits("bearer_token", located(text, fixed.BEARER, 2))),
        (["env_secret"], has("="), lambda: _hits("env_secret", located(text, fixed.ENV, 4))),
        (["passport"], has("pasaport", "passport"), lambda: _hits("passport", located(text, fixed.PASSPORT, 1))),
        (["session_id"], has("sess"), lambda: _texts("session_id", session())),
        (["private_key"], has("---"), lambda: _hits("private_key", located(text, key_block))),
        (["person_name"], has(":", "-", "–") & word(_label_head(fixed.NAME_LABELS)), lambda: _texts("person_name", labelled_names(text, folded))),
        (["location"], _place_guard(text, folded), lambda: _texts("location", place_hits(text, folded))),
        (["person_name"], titled, lambda: _hits("name_pair", located(text, rf"(?iu)(?:\b({fixed.TITLES})\.?\s+)?\b({fixed.NAME_WORD})\s+({fixed.NAME_WORD})\b", 3))),
        *own(False),
    ]
    ten_glyphs = text.rlike("[0-9OoIl|SsBb]{10}")
    return F.concat(F.array().cast(NONE), *behind(any_digit, numbers), *behind(ten_glyphs if may is None else open_to(["tckn", "vkn"]) & ten_glyphs, glyphs), *wanted(families))


def may_begin(text: Column, low: Column, folded: Column, types: list[str]) -> Column:
    """The bits (``type_bits``) of those ``types`` that a text, or any beginning of it that ends with a word, may hold: tests that, passed by a beginning, are passed by the whole.

    For texts that are read again and again, each time a word longer. A type without a test of its own may always be held.
    """
    has = lambda *words: _any([F.contains(folded, F.lit(w)) for w in words])
    count = F.length(F.regexp_replace(text, "[^0-9]", ""))
    nine = (count >= 9) & text.rlike("[0-9]{9}")
    # A name's words stand apart; what follows the first may go on in a glued text, so its end is not asked for.
    named = text.rlike(SPACE) & F.concat(F.lit(" "), folded).rlike(f"[^a-z](?:{any_of([*fixed.GIVEN_NAMES, *[T.plain(t) for t in fixed.TITLES.split('|')]])})")
    labelled = _any([F.contains(text, F.lit(c)) for c in ":-–"]) & folded.rlike(spelled(_label_head(fixed.NAME_LABELS)))
    tests = {
        "email": has("@"), "ipv4": text.rlike(spelled(r"[0-9]\s*[.·•]\s*[0-9]")), "credit_card": count >= 13, "phone": count >= 9, "routing_number": nine,
        "ssn": nine | ((count >= 9) & text.rlike(spelled(r"[0-9]{3}[-\s–—][0-9]{2}[-\s–—][0-9]{4}"))), "tckn": text.rlike("[0-9OoIl|SsBb]{11}"), "session_id": has("sess"),
        "api_token": _may_hold_token(text, low), "person_name": labelled | named, "location": _place_guard(text, folded),
    }
    bits = [F.when(tests.get(t, F.lit(True)), F.lit(type_bits([t], types))).otherwise(0) for t in types]
    return functools.reduce(Column.__add__, bits)


@functools.lru_cache(maxsize=64)
def _search(rules: tuple[Rule, ...], only: tuple[str, ...] | None, context: int, bits: bool = False) -> Column:
    """``raw_hits`` over the columns that ``detect`` makes, put together once for a context: it has thousands of parts."""
    return raw_hits(F.col("_text"), F.col("_low"), F.col("_fold"), rules, list(only) if only is not None else None, F.col("_may") if bits else None)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def detect(rows: DataFrame, keys: list[str], text_col: str = "text", rules: tuple[Rule, ...] = tuple(SAMPLE_RULES), only: list[str] | None = None, carry: tuple[str, ...] = (), every: bool = True, may: str | None = None, dealt: bool = False) -> DataFrame:
    """keys, type, rule_id, label, text, span, start, occurrence, listed, labeled, needs_review, hint columns, and ``carry``.

    ``keys`` name the row (document, page, line). A match is returned at every place of its value; ``listed`` is true for the
    places that a list for readers shows, which has most types' values once. ``span`` is what stands at ``start`` in the
    text; a null start means that the value is nowhere in it. A null text has no matches. Without ``every`` a match stands at its own place
    alone: a value may also be a part of what is no match, as a card of a longer row of numbers. ``may`` names a column with the bits of those
    of ``only`` that a row may hold (``may_begin``). ``dealt``: rows are many and dealt by some of ``keys`` already, so nothing is shuffled.
    """
    # Lower-cased and folded text are read by many families: projections of their own build them once.
    kept = [F.col(c).alias(f"_c_{c}") for c in carry]
    bits = [F.col(may).alias("_may")] if may else []
    taken = rows.select(*keys, *kept, *bits, F.col(text_col).alias("_text"))
    source = (taken if dealt else spread(taken)).select(*keys, *[f"_c_{c}" for c in carry], *(["_may"] if may else []), F.coalesce("_text", F.lit("")).alias("_text")).withColumn("_low", F.lower("_text"))
    # Folding is lower case alone in ASCII.
    source = source.withColumn("_fold", F.when(F.octet_length("_text") == F.length("_text"), F.col("_low")).otherwise(T.fold_turkish(F.col("_text"))))
    hits = source.select(*keys, *[f"_c_{c}" for c in carry], "_text", F.inline(_search(rules, tuple(only) if only is not None else None, id(rows.sparkSession.sparkContext), may is not None)))
    decided = _ibans(_decide(hits, rules)).where(F.col("type").isNotNull() if only is None else F.col("type").isin(only))
    return _unique(_everywhere(decided, every), keys, carry, dealt)


def accepted(hit: dict[str, Column], text: Column, rules: tuple[Rule, ...]) -> tuple[dict, dict[str, Column]]:
    """(family -> [(accepted, type, text, span, hint)], tried in order; labels and places that both kinds of caller need) for one hit's fields."""
    raw, start, g1, g2, g3, g4 = (hit[c] for c in ("raw", "start", "g1", "g2", "g3", "g4"))
    seen = lambda size: T.fold_turkish(before(text, start, size))
    glyph = lambda at: F.substring(text, at, 1)
    fixed_digits = T.correct_digits(raw)
    bare = F.regexp_replace(raw, r"[ \t-]+$", "")
    address = F.regexp_replace(raw, spelled(r"\s*[.·•]\s*"), ".")

    # An eleven-glyph run counts unless it continues a run of glyphs without a letter beside it.
    prev, after = F.when(start > 0, glyph(start)).otherwise(""), glyph(start + F.length(raw) + 1)
    in_run = prev.rlike("[0-9OoIl|SsBb]") | after.rlike("[0-9OoIl|SsBb]")
    beside = ((prev != "") & ~prev.rlike("[0-9OoIl|SsBb]")) | ((after != "") & ~after.rlike("[0-9OoIl|SsBb]"))
    tckn_ok = (beside | ~in_run) & fixed_digits.rlike("^[0-9]{11}$") & checks.tckn(fixed_digits)

    vkn_plain, vkn_label = raw.rlike("^[0-9]{10}$"), seen(48).rlike(spelled(r"(?:^|[^a-z])vergi(?:\s*no)?\b|\bvkn\b"))
    one_glyph = (F.length(F.regexp_replace(raw, "[0-9]", "")) == 1) & checks.vkn(fixed_digits)
    vkn_kept = (vkn_plain & checks.vkn(raw)) | vkn_label | one_glyph

    aba_label, ssn_label = seen(32).rlike(spelled(r"(?:^|[^a-z])(?:routing|rtn|aba|ach)\b")), seen(32).rlike(spelled(r"(?:^|[^a-z])(?:ssn|social\s*security|soc\.?\s*sec)\b"))
    value = F.concat(g2, g3, g4)
    first, second = T.strip_name_suffix(g2), T.strip_name_suffix(g3)
    fold1, fold2 = T.fold_turkish(first), T.fold_turkish(second)
    name_at = F.length(raw) - F.length(F.regexp_extract(raw, spelled(rf"(?iu)({fixed.NAME_WORD}\s+{fixed.NAME_WORD})$"), 1))
    capital = first.rlike("^[A-ZÇĞİÖŞÜ]") & second.rlike("^[A-ZÇĞİÖŞÜ]")
    known = fold1.isin(fixed.GIVEN_NAMES) & (fold2.isin(fixed.SURNAMES) | capital)
    name_ok = (F.length(first) >= 2) & (F.length(second) >= 2) & ~fold1.isin(fixed.NAME_STOPWORDS) & ~fold2.isin(fixed.NAME_STOPWORDS) & (((g1 != "") & capital) | known)
    key_ok = ~checks.public_pem(F.regexp_extract(raw, spelled(fixed.KEY_HEADER), 0))

    table = {
        "email": [(F.lit(True), "email", T.trim_email_tld(raw), raw, None)],
        "ipv4": [(checks.ipv4(address), "ipv4", address, raw, None)],
        "ipv6": [(checks.ipv6(raw), "ipv6", raw, raw, None)],
        "credit_card": [(checks.luhn(bare) & ~checks.repeated_digit(bare), "credit_card", bare, bare, None)],
        "phone": [(F.lit(True), "phone", raw, F.substring(text, start + 1, F.length(raw)), None)],
        "ssn": [(checks.ssn(raw), "ssn", raw, raw, None)],
        "tckn": [(tckn_ok, "tckn", fixed_digits, raw, None)],
        "vkn": [(vkn_kept & fixed_digits.rlike("^[0-9]{10}$"), "vkn", fixed_digits, raw, None), (~vkn_kept, "vkn", fixed_digits, raw, "vkn_unverified")],
        "iban": [(F.lit(True), "custom_rule", F.trim(raw), F.trim(raw), None)],
        "api_token": [(F.lit(True), "api_token", raw, raw, None)],
        "connection_url": [(F.lit(True), "connection_url", raw, raw, None)],
        "bearer_token": [(F.lit(True), "bearer_token", F.concat(F.lit("Bearer "), g2), g1, None)],
        "env_secret": [(g1.rlike(fixed.ENV_KEY) & (F.length(value) >= 8), "env_secret", value, value, None), (g1.rlike(fixed.ENV_KEY) & (value != ""), "env_secret", value, value, "short_secret")],
        "passport": [(F.lit(True), "passport", F.upper(g1), g1, None)],
        "session_id": [(F.lit(True), "session_id", raw, raw, None)],
        "private_key": [(key_ok, "private_key", F.regexp_replace(raw, f"{SPACE}+$", ""), F.regexp_replace(raw, f"{SPACE}+$", ""), None)],
        "person_name": [(F.lit(True), "person_name", raw, raw, None)],
        "name_pair": [(name_ok, "person_name", F.concat_ws(" ", first, second), F.substring(raw, name_at + 1, F.length(raw) - name_at - F.length(g3) + F.length(second)), None)],
        "location": [(F.lit(True), "location", raw, raw, None)],
        **{f"rule:{r.id}": [(F.trim(raw) != "", "custom_rule", F.trim(raw), F.trim(raw), "custom_id" if r.id == "custom-id" else None)] for r in rules},
    }
    # A bare nine-digit run may be a social security number and a routing number at once.
    nine = F.array(
        F.when(checks.ssn(raw), F.struct(F.lit("ssn").alias("type"), raw.alias("text"), raw.alias("span"), F.when(~ssn_label, "ssn_unlabeled").alias("hint"))),
        F.when(checks.aba(raw) | (checks.aba_prefix(raw) & aba_label), F.struct(F.lit("routing_number").alias("type"), raw.alias("text"), raw.alias("span"), F.when(~checks.aba(raw), "routing_unverified").alias("hint"))),
    )
    return table | {"nine": nine}, {"vkn_label": vkn_label, "name_at": name_at}


def first_of(options: list[tuple]) -> Column:
    """array<struct<type, text, span, hint>> of the first option that is accepted; null where none is."""
    cases = None
    for ok, kind, shown, span, hint in options:
        made = F.array(F.struct(F.lit(kind).alias("type"), shown.alias("text"), span.alias("span"), F.lit(hint).cast("string").alias("hint")))
        cases = F.when(ok, made) if cases is None else cases.when(ok, made)
    return cases


@functools.lru_cache(maxsize=64)
def _choice(rules: tuple[Rule, ...], context: int) -> tuple[Column, dict[str, Column]]:
    """What becomes of a hit, by its family, over the columns of ``raw_hits``; put together once for a context."""
    family = F.col("family")
    table, also = accepted({c: F.col(c) for c in ("raw", "start", "g1", "g2", "g3", "g4")}, F.col("_text"), rules)
    chosen = F.when(family == "nine", table["nine"])
    for name, options in table.items():
        if name != "nine":
            chosen = chosen.when(family == name, first_of(options))
    return F.filter(chosen, lambda m: m.isNotNull()), also


def _decide(hits: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    family, raw, start, text = F.col("family"), F.col("raw"), F.col("start"), F.col("_text")
    chosen, also = _choice(rules, id(hits.sparkSession.sparkContext))
    found = hits.withColumn("_m", F.explode(chosen))
    rule = F.when(F.startswith(family, F.lit("rule:")), F.substring(family, 6, 60)).when(family == "iban", "iban").when(F.col("_m.type") == "tckn", "tckn")
    names = {f"rule:{r.id}": r.label for r in rules} | {"iban": fixed.LABELS["iban"]}
    label = F.coalesce(*[F.when(family == k, F.lit(v)) for k, v in names.items()], *[F.when(F.col("_m.type") == k, F.lit(v)) for k, v in fixed.LABELS.items()])
    shown_key = F.when(family == "env_secret", F.col("g1"))
    labeled = F.when(family == "vkn", also["vkn_label"]).when(family == "passport", True).when(family == "phone", before(T.rewrite_trunk_o(text), start, 24).rlike(spelled(r"(?i)(?:^|[^a-z])(?:tel|telefon|phone)\s*:?\s*$"))).otherwise(False)
    original = F.substring(text, start + 1, F.length(raw))
    ocr = F.when(family == "phone", (start >= 0) & (original != raw)).otherwise(False)
    skipped = (family == "phone") & F.col("labeled") & raw.rlike("^0(?!0)") & ~checks.turkish_carrier(raw)
    out = found.select("*", "_m.type", "_m.span", F.col("_m.text").alias("text"), F.col("_m.hint").alias("hint"), rule.alias("rule_id"), label.alias("label"), shown_key.alias("key"), F.coalesce(labeled, F.lit(False)).alias("labeled"), F.coalesce(ocr, F.lit(False)).alias("ocr_corrected"))
    out = out.withColumn("carrier_skipped", F.coalesce(skipped, F.lit(False)))
    # A span inside its match starts later: at the end for values and tokens, at the first name for names.
    tail = F.length("raw") - F.length("span")
    inner = F.when(family.isin("bearer_token", "passport"), tail).when(family == "env_secret", tail - F.when((F.col("g2") != "") | (F.col("g3") != ""), 1).otherwise(0)).when(family == "name_pair", also["name_at"]).when(family == "iban", F.greatest(F.instr(F.col("raw"), F.col("span")) - 1, F.lit(0))).otherwise(0)
    part = F.coalesce((family == "phone") & (F.col("g1") == "part"), F.lit(False))
    return out.withColumns({"start": F.col("start") + inner, "_part": part}).drop("_m", "raw", "g1", "g2", "g3", "g4")


def _everywhere(rows: DataFrame, every: bool = True) -> DataFrame:
    """Each match at every place of its value in the text, or at its own where it has one; values put together from pieces at the pieces' places.

    A value that is nowhere keeps a null start. Spans are the text's own characters.
    """
    text, span, start = F.col("_text"), F.col("span"), F.col("start")
    none = F.array().cast(PLACE)
    own = F.array(F.struct(start.alias("start"), F.length(span).alias("size")).cast(PLACE[6:-1]))
    others = lambda exact: F.filter(exact, lambda x: (x["start"] >= start + F.length(span)) | (x["start"] + x["size"] <= start))
    found = bound(occurrences(text, span), lambda exact: F.when(start.isNotNull(), F.array_union(own, others(exact))).when(F.size(exact) > 0, exact).otherwise(loose_occurrences(text, span)))
    # Most values stand once: no other place is before or behind.
    once = (F.call_function("locate", span, text, F.lit(1)) == start + 1) & (F.call_function("locate", span, text, start + F.length(span) + 1) == 0)
    found = F.when(start.isNotNull() if not every else start.isNotNull() & once, own).otherwise(found)
    placed = rows.withColumn("_at", F.explode_outer(F.coalesce(found, none)))
    return placed.withColumns({"start": F.col("_at.start"), "span": F.coalesce(F.substring(text, F.col("_at.start") + 1, F.col("_at.size")), span)}).drop("_at")


def _ibans(rows: DataFrame) -> DataFrame:
    """Country repair, single-glyph repair and the policy for account numbers; other rows pass."""
    mine, text = F.col("family") == "iban", F.col("text")
    compact = T.compact_iban(text)
    swapped = F.translate(F.substring(compact, 1, 2), *fixed.IBAN_DIGIT_TO_LETTER)
    # A digit in the country code stands for one letter, so there is one repaired code at most.
    repaired = F.concat(swapped, F.substring(compact, 3, 64))
    rows = rows.withColumns({"_structure": F.when(mine, checks.iban_structure(text)).otherwise(True), "_repaired": F.when(mine, repaired)})
    fits = checks.iban_structure(F.col("_repaired"))
    rows = rows.withColumn("_fits", F.when(mine & ~F.col("_structure"), fits).otherwise(False)).where(F.col("_structure") | F.col("_fits"))
    lead = r"^([^A-Za-z0-9]*)[A-Za-z0-9]([^A-Za-z0-9]*)[A-Za-z0-9]"
    spaced = F.concat(F.regexp_extract(text, lead, 1), F.substring(swapped, 1, 1), F.regexp_extract(text, lead, 2), F.substring(swapped, 2, 1), F.regexp_replace(text, lead, ""))
    rows = rows.withColumn("_working", F.when(F.col("_fits"), spaced).otherwise(text))
    rows = rows.withColumn("_compact", F.when(mine, T.compact_iban(F.col("_working"))))
    rows = rows.withColumn("_sound", F.when(mine, checks.mod97(F.col("_compact")) == 1))
    c = F.col("_compact")
    fixes = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.translate(F.substring(c, i, F.lit(1)), *fixed.IBAN_LETTER_TO_DIGIT), F.substring(c, i + 1, F.lit(64))))
    rows = rows.withColumn("_fixes", F.when(mine & ~F.col("_sound"), F.filter(fixes, lambda x: x != c)))
    rows = rows.withColumn("_fixed", F.get(F.filter("_fixes", lambda x: x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (checks.mod97(x) == 1)), 0))
    label = T.fold_turkish(before(F.col("_text"), F.col("start"), 48)).rlike(spelled(r"(?:^|[^a-z])iban\b"))
    checked = F.coalesce(F.col("_sound") | F.col("_fixed").isNotNull(), F.lit(False))
    only = mine & ~checked & F.col("_fits") & ~label
    rows = rows.withColumns({
        "iban_checksum_valid": mine & checked,
        "iban_checksum_failed": mine & ~checked & ~only,
        "ocr_corrected": F.col("ocr_corrected") | F.coalesce(F.col("_fixed").isNotNull() | F.col("_fits"), F.lit(False)),
        "hint": F.when(only, "iban_pattern_only").otherwise(F.col("hint")),
        "text": F.when(mine, F.coalesce("_fixed", "_working")).otherwise(text),
    })
    return rows.drop("_structure", "_repaired", "_fits", "_working", "_compact", "_sound", "_fixes", "_fixed")


def _unique(rows: DataFrame, keys: list[str], carry: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """One row a place, with ordinals of equal values; ``listed`` for the first of equal values of types that list values once."""
    same = F.when(F.col("type") == "person_name", T.name_key(F.col("text"))).when(F.col("family") == "iban", F.col("span")).otherwise(F.col("text"))
    order = [F.coalesce("start", F.lit(1 << 30)), "family", "span"]
    once = F.col("family").isin(ONCE) | F.startswith("family", F.lit("rule:")) | F.col("type").isin("person_name", "location", "phone", "ssn", "routing_number")
    # All windows run within a row of the source: its matches are shuffled once.
    near = rows.withColumns({"_once": once, "_same": F.when(once, same).otherwise(F.col("span"))})
    near = near if dealt else near.repartition(*keys)
    kind = [*keys, "type", "rule_id", "_once", "_same"]
    single = near.withColumn("_copy", F.row_number().over(Window.partitionBy(*kind, "start", "span").orderBy("_part", "family", "text"))).where("_copy = 1")
    ranked = single.withColumn("_rank", F.row_number().over(Window.partitionBy(*kind).orderBy(*order)))
    kept = ranked.where((F.col("type") != "person_name") | (T.name_key(F.col("text")) != ""))
    listed = ~F.col("_part") & (~F.col("_once") | (F.col("_rank") == 1))
    return kept.select(*keys, "type", "rule_id", "label", "text", "span", "start", (F.col("_rank") - 1).alias("occurrence"), listed.alias("listed"), "key", "labeled", (F.col("hint").isNotNull() | (F.col("type") == "seed_phrase")).alias("needs_review"), "hint", "ocr_corrected", "carrier_skipped", "iban_checksum_valid", "iban_checksum_failed", *[F.col(f"_c_{c}").alias(c) for c in carry])
