"""Column functions on text: matches with offsets, keys, validators, markers."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import LANGUAGES, MARKERS

_CUT, _SUB = "\x01", "\x02"
MATCHES = "array<struct<start:int,end:int,text:string>>"


def guarded(text: Column) -> Column:
    """The text with the two sentinel characters replaced by spaces; offsets stay."""
    return F.translate(F.coalesce(text, F.lit("")), _CUT + _SUB, "  ")


def once(value: Column) -> Column:
    """``value`` as a generated column: what stands above reads it, and never works it out a second time
    (a plain column is merged into the filters and projections that use it)."""
    return F.explode(F.array(value))


def fenced(text: Column, regex: str | Column, group: bool = False) -> Column:
    """The text with a sentinel before and after each match; with ``group`` another one before group 1,
    which ends the match."""
    return F.regexp_replace(text, F.lit(regex), F.lit(_CUT + "$0" + (_SUB + "$1" if group else "") + _CUT))


def fenced_matches(fences: Column) -> Column:
    """The matches in a text that :func:`fenced` made: split at the sentinel it is gap, match, gap, ...,
    and running lengths give the offsets.  Empty matches are left out."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(MATCHES).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        value = F.substring_index(part, _SUB, -1)
        end = acc["at"] + F.length(F.substring_index(part, _SUB, 1))
        hit = F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("text"))
        out = F.when((acc["k"] % 2 == 1) & (value != ""), F.concat(acc["out"], F.array(hit))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (acc["k"] + 1).alias("k"), out.alias("out"))

    return F.aggregate(F.split(fences, _CUT, -1), zero, step, lambda acc: acc["out"])


def matches(text: Column, regex: str, group: bool = False) -> Column:
    """All matches with half-open code-point offsets, without leaving the JVM.  With ``group`` the span is
    group 1, the end of the match."""
    return F.when(text.rlike(regex), fenced_matches(fenced(text, regex, group))).otherwise(F.array().cast(MATCHES))


def _digits(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _only(value: Column, kept: str) -> Column:
    return F.regexp_replace(value, f"[^{kept}]", "")


_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_CONTROL = "JABCDEFGHI"


def _pick(table: str, index: Column) -> Column:
    return F.substring(F.lit(table), index.cast("int") + 1, F.lit(1))


def valid_rut(value: Column) -> Column:
    """Weights 2 to 7 in turn from the right, modulo 11."""
    body = F.upper(_only(value, "0-9kK"))
    number, check = F.substring(body, F.lit(1), F.length(body) - 1), F.right(body, F.lit(1))
    total = _sum(F.transform(F.reverse(_digits(number)), lambda d, i: d * (i % 6 + 2)))
    rest = 11 - total % 11
    expected = F.when(rest == 11, "0").when(rest == 10, "K").otherwise(rest.cast("string"))
    return F.length(body).between(8, 9) & number.rlike("^[0-9]+$") & (check == expected)


def valid_dni(value: Column) -> Column:
    """Eight digits and the letter of their remainder by 23."""
    clean = F.upper(_only(value, "0-9A-Za-z"))
    return clean.rlike("^[0-9]{8}[A-Z]$") & (_pick(_LETTERS, F.substring(clean, 1, 8).try_cast("long") % 23) == F.right(clean, F.lit(1)))


def valid_nie(value: Column) -> Column:
    """X, Y, Z stand for 0, 1, 2; then as for eight digits."""
    clean = F.upper(_only(value, "0-9A-Za-z"))
    return clean.rlike("^[XYZ][0-9]{7}[A-Z]$") & valid_dni(F.concat(F.translate(F.left(clean, F.lit(1)), "XYZ", "012"), F.substring(clean, 2, 8)))


def valid_cif(value: Column) -> Column:
    """Second, fourth, sixth digits plain, the others doubled and summed by digit; the letter says how the control looks."""
    clean = F.upper(_only(value, "0-9A-Za-z"))
    each = F.transform(_digits(F.substring(clean, 2, 7)), lambda d, i: F.when(i % 2 == 1, d).otherwise(F.floor(d * 2 / 10).cast("int") + d * 2 % 10))
    control = (10 - _sum(each) % 10) % 10
    first, last = F.left(clean, F.lit(1)), F.right(clean, F.lit(1))
    digit, letter = last == control.cast("string"), last == _pick(_CONTROL, control)
    fits = F.when(first.rlike("[PQRSNW]"), letter).when(first.rlike("[ABEH]"), digit).otherwise(digit | letter)
    return clean.rlike("^[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-Z]$") & fits


def valid_iban(value: Column) -> Column:
    """Four characters to the end, letters as 10 to 35, remainder 1 by 97, folded character by character."""
    clean = F.upper(F.regexp_replace(value, r"(?U)\s", ""))
    turned = F.filter(F.split(F.concat(F.substring(clean, F.lit(5), F.length(clean)), F.left(clean, F.lit(4))), ""), lambda c: c != "")
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.length(clean).between(15, 34) & clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (rest == 1)


def valid_luhn(value: Column) -> Column:
    digits = _only(value, "0-9")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


CHECKS = {"rut": valid_rut, "dni": valid_dni, "nie": valid_nie, "cif": valid_cif, "iban": valid_iban, "luhn": valid_luhn}

@cache
def _folding() -> tuple[str, str, str, str, dict[str, str]]:
    """Tables made from the Unicode database: letters with marks and their plain ones, lone marks, and what case
    folding does beyond small letters (for one character each; longer ones apart)."""
    chars = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") for c in chars}
    plain = {c: b for c, b in bare.items() if len(b) == 1 and b != c}
    marks = "".join(c for c, b in bare.items() if not b)
    folded = {c: c.lower().casefold() for c in chars if c not in plain and c == c.lower() and c.casefold() != c}
    short = {c: f for c, f in folded.items() if len(f) == 1}
    long = {c: f for c, f in folded.items() if len(f) > 1 and all(x not in marks for x in f)}
    return "".join(plain) + marks, "".join(plain.values()), "".join(short), "".join(short.values()), long


def strip_accents(value: Column) -> Column:
    """The text decomposed and without its marks."""
    old, new, *_ = _folding()
    return F.translate(value, old, new)


def casefold(value: Column) -> Column:
    """Small letters, and what Unicode folds beyond them (``ß`` to ``ss``)."""
    _, _, old, new, long = _folding()
    value = F.translate(F.lower(value), old, new)
    rare = reduce(lambda v, pair: F.replace(v, F.lit(pair[0]), F.lit(pair[1])), long.items(), value)
    return F.when(value.rlike("[" + "".join(long) + "]"), rare).otherwise(value)


# Honorifics and company endings that are no part of a name.
HONORIFIC = r"^(?:(?:sr|sra|srta|d|dn|dna|don|dona|dr|dra|prof|profa|ing|lic|mr|mrs|ms|miss)\.?\s+)+"
COMPANY = r"(?:[\s,]+(?:s\.?\s?[all]\.?|s\.?\s?a\.?\s?s?\.?|sl|sa|sas|spa|ltda?|inc|corp|co|gmbh|bv|nv|plc|llc|srl)\.?)+$"
EDGES = r"""^[\s"'(\[.,;:-]+|[\s"')\].,;:-]+$"""


def entity_key(surface: Column, kind: Column) -> Column:
    """What makes two surfaces one entity: no edge punctuation, single spaces, no accents, lower case,
    no honorifics, and for organisations no company ending."""
    value = F.regexp_replace(surface, EDGES, "")
    value = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    value = casefold(strip_accents(value))
    value = F.trim(F.regexp_replace(value, HONORIFIC, ""))
    return F.when(kind == "ORG", F.trim(F.regexp_replace(value, COMPANY, ""))).otherwise(value)


def marker_name(kind: Column, language: str) -> Column:
    at = LANGUAGES.index(language) if language in LANGUAGES else 0
    pairs = [F.lit(x) for k, names in MARKERS.items() for x in (k, names[at])]
    return F.coalesce(F.create_map(*pairs)[kind], kind)


def marker(kind: Column, n: Column, language: str = "es", brackets: bool = True) -> Column:
    left, right = ("[", "]") if brackets else ("(", ")")
    return F.concat(F.lit(left), marker_name(kind, language), F.lit("_"), n.cast("string"), F.lit(right))


def without_brackets(value: Column) -> Column:
    return F.translate(value, "[]", "()")


def sheet_title(value: Column) -> Column:
    """A marker-bearing text as a worksheet title: no brackets, 31 characters."""
    return F.substring(without_brackets(value), 1, 31)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
