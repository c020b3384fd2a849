"""Validators: boolean Column functions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.patterns import SPACE, bound, digits, spelled
from maskwright.functions.text import compact_iban


def _digit(text: Column, place: int) -> Column:
    """The digit at a place from 1, 0 beyond the end; only meaningful where the shape was checked."""
    return F.coalesce(F.substring(text, place, 1).try_cast("int"), F.lit(0))


def luhn(text: Column) -> Column:
    d = digits(text)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def repeated_digit(text: Column) -> Column:
    return digits(text).rlike(r"^([0-9])\1{12,18}$")


def tckn(text: Column) -> Column:
    return bound(digits(text), _tckn)


def _tckn(d: Column) -> Column:
    odd, even = sum((_digit(d, k) for k in (1, 3, 5, 7, 9)), F.lit(0)), sum((_digit(d, k) for k in (2, 4, 6, 8)), F.lit(0))
    tenth = F.pmod(odd * 7 - even, F.lit(10))
    return d.rlike("^[1-9][0-9]{10}$") & (_digit(d, 10) == tenth) & (_digit(d, 11) == (odd + even + _digit(d, 10)) % 10)


def tckn_evidence(text: Column) -> Column:
    """Names of the tests that a number passes."""
    d = digits(F.translate(text, *fixed.LETTER_TO_DIGIT))
    tests = [("11-digit", F.length(d) == 11), ("first-digit-nonzero", d.rlike("^[1-9]")), ("checksum-valid", tckn(d))]
    return F.filter(F.array(*[F.when(ok, F.lit(name)) for name, ok in tests]), lambda x: x.isNotNull())


def vkn(text: Column) -> Column:
    return bound(digits(text), _vkn)


def _vkn(d: Column) -> Column:
    total = F.lit(0)
    for place in range(1, 10):
        moved = (_digit(d, place) + (10 - place)) % 10
        part = (moved * (1 << (10 - place))) % 9
        total = total + F.when((moved != 0) & (part == 0), 9).otherwise(part)
    return d.rlike("^[0-9]{10}$") & (F.pmod(10 - total % 10, F.lit(10)) == _digit(d, 10))


def iban_country_length(country: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.IBAN_LENGTHS.items() for x in pair])
    return F.try_element_at(table, country)


def iban_structure(text: Column) -> Column:
    c = compact_iban(text)
    return F.coalesce(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.length(c) == iban_country_length(F.substring(c, 1, 2))), F.lit(False))


def mod97(compact: Column) -> Column:
    """Remainder of an IBAN's number, its first four characters moved to the end."""
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).when(c.rlike("[A-Z]"), (r * 100 + F.ascii(c) - 55) % 97).otherwise(r)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def iban_checksum(text: Column) -> Column:
    return iban_structure(text) & (mod97(compact_iban(text)) == 1)


def ssn(text: Column) -> Column:
    d = digits(text)
    return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def aba_prefix(text: Column) -> Column:
    d = digits(text)
    first = F.substring(d, 1, 2).try_cast("int")
    return d.rlike("^[0-9]{9}$") & (first.between(0, 12) | first.between(21, 32) | first.between(61, 72) | (first == 80))


def aba(text: Column) -> Column:
    d = digits(text)
    total = sum((_digit(d, k) * (3, 7, 1)[(k - 1) % 3] for k in range(1, 10)), F.lit(0))
    return aba_prefix(d) & (total % 10 == 0)


def phone_shape(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike("^[+0(]") & F.length(digits(t)).between(10, 15) & t.rlike(spelled(r"^\+?\(?[0-9][0-9\s().-]{8,22}[0-9]$"))


def turkish_carrier(text: Column) -> Column:
    d = digits(text)
    local = F.when(F.startswith(d, F.lit("0090")), F.substring(d, 5, 64)).when(F.startswith(d, F.lit("90")) & (F.length(d) >= 12), F.substring(d, 3, 64)).when(F.startswith(d, F.lit("0")) & (F.length(d) >= 11), F.substring(d, 2, 64)).otherwise(d)
    return local.rlike("^(?:5[0-69][0-9]{8}|[2-4][0-9]{9})$")


def port(text: Column) -> Column:
    return F.coalesce(text.try_cast("int").between(1, 65535), F.lit(False))


def ipv4(text: Column) -> Column:
    parts = F.split(text, ":", 2)
    address = F.get(parts, 0).rlike(rf"^(?:{fixed.OCTET}\.){{3}}{fixed.OCTET}$")
    return address & ((F.size(parts) == 1) | port(F.get(parts, 1)))


def ipv6_body(text: Column) -> Column:
    """Eight groups, or fewer around one double colon, which isn't all there is."""
    groups = F.size(F.filter(F.split(text, ":"), lambda g: g != ""))
    full = text.rlike(f"(?i)^{fixed.IPV6_FULL}$")
    short = text.rlike(f"(?i)^(?:{fixed.HEXTET}(?::{fixed.HEXTET})*)?::(?:{fixed.HEXTET}(?::{fixed.HEXTET})*)?$") & groups.between(1, 7)
    return full | short


def ipv6(text: Column) -> Column:
    bracket, plain = r"(?i)^\[([0-9a-f:]+)\]:([0-9]{1,5})$", r"^(.*):([0-9]{1,5})$"
    part = lambda p, k: F.regexp_extract(text, p, k)
    return F.when(text.rlike(bracket), ipv6_body(part(bracket, 1)) & port(part(bracket, 2))).otherwise(ipv6_body(text) | (text.rlike(plain) & ipv6_body(part(plain, 1)) & port(part(plain, 2))))


def ipv6_fragment(text: Column) -> Column:
    """Whether a scanned word may be a piece of an address."""
    t = F.trim(text)
    shapes = [r"^[0-9a-f]{1,4}$", r"^:+$", r"^:[0-9a-f]{1,4}$", r"^\]:[0-9]{1,5}$", r"^\[?(?:[0-9a-f]{1,4}:){1,7}[0-9a-f]{0,4}\]?(?::[0-9]{1,5})?$", r"^(?=.*[0-9a-f])\[?[0-9a-f:]*::[0-9a-f:]*\]?(?::[0-9]{1,5})?$"]
    return (F.length(t) <= 80) & t.rlike("(?i)" + "|".join(f"(?:{s})" for s in shapes))


def log_identifier(token: Column) -> Column:
    """Three pieces or more, three quarters of the letters in words of four and more: a name, not a secret."""
    pieces = F.filter(F.split(token, "[_=+/-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), lambda p: p != "")
    letters = F.length(F.regexp_replace(token, "[^A-Za-z]", ""))
    worded = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.when(p.rlike("^[A-Za-z]{4,}$"), F.length(p)).otherwise(0))
    return (F.size(pieces) >= 3) & (letters > 0) & (worded >= 0.75 * letters)


def mixed_kinds(token: Column) -> Column:
    """At least three of lower case, upper case, digits and other characters."""
    return sum((token.rlike(k).cast("int") for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0)) >= 3


def api_token(token: Column) -> Column:
    compact = F.regexp_replace(token, f"{SPACE}+", "")
    explicit = compact.rlike(fixed.EXPLICIT_PREFIX)
    short = (compact.rlike("(?i)^ghp_") & (F.length(compact) < 24)) | (compact.rlike("(?i)^github_pat_") & (F.length(compact) < 31))
    return (~token.rlike(SPACE) | explicit) & (F.length(compact) >= 16) & ~(short & ~compact.rlike("[0-9]"))


def truncated_credential(token: Column) -> Column:
    compact = F.regexp_replace(token, f"{SPACE}+", "")
    stripe = r"(?is)^(?:sk|pk|rk)_(?:live|test)_(.*)$"
    return F.when(compact.rlike(stripe), F.length(F.regexp_extract(compact, stripe, 1)) < 24).when(compact.rlike("(?i)^ghp_"), F.length(compact) < 24).when(compact.rlike("(?i)^github_pat_"), F.length(compact) < 31).otherwise(False)


def public_pem(text: Column) -> Column:
    return text.rlike(r"(?i)CERTIFICATE|(?:^|[^A-Z])PUBLIC[ \t]+KEY")


def base64_line(text: Column) -> Column:
    # Prose ends the first test at its first sign.
    plain = ~text.rlike(f"[^A-Za-z0-9+/=\u0085{SPACE[1:-1]}]")
    compact = F.regexp_replace(text, f"{SPACE}+", "")
    return plain & (F.length(compact) >= 20) & compact.rlike("^[A-Za-z0-9+/=]+$")


def broken_key_header(text: Column) -> Column:
    return ~public_pem(text) & F.translate(F.upper(text), "01", "OI").rlike(spelled(r"\b(?:BEGIN|PRIVATE|KEY)\b"))


def unsafe_pattern(pattern: str) -> bool:
    """Nested repeats that may take exponential time; judged on the driver, before a rule is used."""
    import re

    return bool(re.search(r"(\([^)]*[+*][^)]*\))[+*{]|\{\d+,?\d*\}\s*[+*]", pattern))
