"""Text normalisers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.patterns import SPACE, spelled


def fold_turkish(text: Column) -> Column:
    """Lower case without Turkish marks, one character for each: positions carry over to the source."""
    return F.lower(F.translate(text, "İIŞşĞğÜüÖöÇçıâîû", "iissgguuoocciaiu"))


def plain(word: str) -> str:
    """A word of our own lists as ``fold_turkish`` makes it."""
    return word.translate(str.maketrans("İIŞşĞğÜüÖöÇçıâîû", "iissgguuoocciaiu")).lower()


def sanitize_token(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[.,;:!]+$", "")


def sanitize_text(text: Column) -> Column:
    """Each word without closing punctuation, blanks squeezed; line breaks stay."""
    bare = F.regexp_replace(text, f"[.,;:!]+(?={SPACE}|$)", "")
    return F.trim(F.regexp_replace(bare, r"[\t\x0b-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", " "))


def sanitize_line(text: Column) -> Column:
    """Line breaks of one kind, other white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[^\\S\n]+", " "))


def extend_name_suffix(line: Column, start: Column, size: Column) -> Column:
    """The length of a name at ``start`` with the case ending that an apostrophe joins to it, where one follows."""
    tail = fold_turkish(F.substring(line, start + size + 1, F.length(line)))
    ending = "|".join(sorted(fixed.NAME_SUFFIXES, key=lambda w: (-len(w), w)))
    return size + F.length(F.regexp_extract(tail, f"^(['’´`](?:{ending}))(?![a-z0-9])", 1))


def one_dash(text: Column) -> Column:
    """Dashes and underscores of all kinds as one, without blanks around; most texts are so already, and are not rewritten."""
    far = (F.octet_length(text) != F.length(text)) & text.rlike("[‐‑‒–—−＿﹍﹎]")
    plain = F.regexp_replace(F.regexp_replace(text, "[‐‑‒–—−]", "-"), "[＿﹍﹎]", "_")
    closed = F.regexp_replace(F.regexp_replace(plain, spelled(r"\s*_\s*"), "_"), spelled(r"\s*-\s*"), "-")
    return F.when(far | text.rlike(spelled(r"[-_](?:\s|(?<=\s[-_]))")), closed).otherwise(text)


def normalize_credential(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(one_dash(F.trim(text)), f"{SPACE}+", ""), "[.,;:!?]+$", "")


def correct_digits(text: Column) -> Column:
    """Letters that scanners read for digits, as digits."""
    return F.translate(text, *fixed.LETTER_TO_DIGIT)


def rewrite_trunk_o(text: Column) -> Column:
    """A letter O that stands alone before digits is a zero."""
    return F.regexp_replace(text, spelled(r"[OoΟοОоØø](?<![A-Za-z0-9][OoΟοОоØø])(?=\s*[0-9])"), "0")


def compact_iban(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, spelled(r"[\s-]+"), ""))


def strip_name_suffix(token: Column) -> Column:
    """A name without the case ending after its apostrophe."""
    ending = "|".join(sorted(fixed.NAME_SUFFIXES, key=len, reverse=True))
    last = F.regexp_extract(token, r"^(.{2,})['’´`]([^'’´`]*)$", 1)
    suffix = fold_turkish(F.regexp_extract(token, r"^(.{2,})['’´`]([^'’´`]*)$", 2))
    return F.when((last != "") & suffix.rlike(f"^(?:{ending})$"), last).otherwise(token)


def name_key(text: Column) -> Column:
    """What makes two spellings the same name."""
    words = F.split(F.trim(text), f"{SPACE}+")
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(fold_turkish(strip_name_suffix(w)), "[^a-z0-9]", "")), "")


def format_api_token(text: Column) -> Column:
    """Separators put back into tokens that were read without them."""
    stripe, api = r"(?i)^(sk|pk|rk)(live|test)([A-Za-z0-9]{24,})$", r"(?i)^api(test|live)([a-z0-9_-]{8,})$"
    part = lambda p, k: F.regexp_extract(text, p, k)
    return (
        F.when(text.rlike(stripe), F.concat(F.lower(part(stripe, 1)), F.lit("_"), F.lower(part(stripe, 2)), F.lit("_"), part(stripe, 3)))
        .when(text.rlike(api), F.concat(F.lit("api_"), F.lower(part(api, 1)), F.lit("_"), part(api, 2)))
        .otherwise(text)
    )


def label_text(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.translate(text, "İI", "ii")), "ı", "i"), "[^a-z0-9]", "")


def detection_text(text: Column) -> Column:
    """Text under which two detections are compared."""
    return F.lower(F.regexp_replace(text, f"{SPACE}+", ""))


def trim_email_tld(email: Column) -> Column:
    """An address cut at the longest known top-level domain that its own begins with; known ones stay."""
    stem, tld = F.regexp_extract(email, r"^(.*\.)([A-Za-z]{2,24})$", 1), F.lower(F.regexp_extract(email, r"^(.*\.)([A-Za-z]{2,24})$", 2))
    known = F.array(*map(F.lit, sorted(fixed.TLDS, key=lambda t: (-len(t), t))))
    prefix = F.get(F.filter(known, lambda t: F.startswith(tld, t)), 0)
    return F.when((stem == "") | prefix.isNull(), email).otherwise(F.concat(stem, F.when(F.array_contains(known, tld), tld).otherwise(prefix)))


def credential_search_text(text: Column) -> Column:
    """White space as NUL, so that a URL can be followed over scanner gaps; positions stay."""
    return F.regexp_replace(text, SPACE, "\x00")


def strip_html(html: Column) -> Column:
    """Visible text of a page: scripts, styles and comments dropped, tags as line or word breaks, common entities decoded."""
    text = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def redacted_name(stamp: Column, name: Column) -> Column:
    """File name of a redacted copy: UTC stamp, extension of a known kind or else png."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.concat(F.lit("redacted-"), F.date_format(stamp, "yyyyMMdd-HHmmss"), F.lit("."), F.when(ext.isin("png", "jpg", "jpeg", "webp", "pdf"), ext).otherwise("png"))


def metadata_markers(data: Column) -> Column:
    """Metadata traces in a file's bytes, as an array of names."""
    raw = F.decode(data, "ISO-8859-1")
    has = lambda *words: [F.contains(raw, F.lit(w)) for w in words]
    make, model = has("Make", "Model")
    gps = raw.rlike(spelled(r"GPSLatitude|GPSLongitude|\bGPS\b"))
    marks = [("Exif", has("Exif")[0]), ("xap", has("http://ns.adobe.com/xap")[0]), ("GPS", gps), ("Make/Model", make & model), ("DateTime", has("DateTime")[0])]
    return F.filter(F.array(*[F.when(found, F.lit(name)) for name, found in marks]), lambda m: m.isNotNull())
