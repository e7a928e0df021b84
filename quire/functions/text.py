"""Text normalisation as pure column expressions, so that Catalyst sees and codegen covers them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beta Code letters of the Greek alphabet, and its signs for combining marks.
BETA_LETTERS = ("αβγδεζηθικλμνξοπρσςτυφχψω", "abgdezhqiklmncoprsstufxyw")
BETA_MARKS = {"̓": ")", "̔": "(", "́": "/", "̀": "/", "͂": "=", "̈": "+", "ͅ": "|"}
GREEK_NUMBERS = {**dict(zip("αβγδεϛζηθ", range(1, 10))), **dict(zip("ικλμνξοπϟ", range(10, 100, 10))), **dict(zip("ρστυφχψωϡ", range(100, 1000, 100)))}
ROMAN_NUMBERS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


@lru_cache(1)
def _bases() -> tuple[str, str]:
    """Precomposed letters with their base letter, then combining marks to delete."""
    src, dst = [], []
    for c in range(0xA0, 0x2000):
        ch = chr(c)
        d = unicodedata.normalize("NFD", ch)
        if d != ch and not unicodedata.combining(d[0]) and all(unicodedata.combining(x) for x in d[1:]):
            src.append(ch)
            dst.append(d[0])
    marks = [chr(c) for a, b in ((0x300, 0x370), (0x1AB0, 0x1ACF), (0x20D0, 0x20F1), (0xFE00, 0xFE10)) for c in range(a, b)]
    return "".join(src + marks), "".join(dst)


def strip_accents(c: Column) -> Column:
    return F.translate(c, *_bases())


def fold(c: Column) -> Column:
    """Search key: lower case, no accents, ligatures spelt out, v as u, j as i."""
    s = F.replace(F.replace(F.lower(c), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.translate(strip_accents(s), "vj", "ui")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def trim_punct(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{P}]+|[\s\p{P}]+$", "")


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.translate(strip_accents(F.lower(c)), "ς", "σ"), r"[^\p{L}]+", "")


def beta(c: Column) -> Column:
    """Accentless Beta Code of Greek letters; other characters stay."""
    return F.translate(strip_accents(F.lower(c)), *BETA_LETTERS)


def greek_from_beta(c: Column) -> Column:
    """Accentless Greek of Beta Code; sigma at a word's end takes its final form."""
    greek, code = "".join(ch for ch in BETA_LETTERS[0] if ch != "ς"), "".join(b for ch, b in zip(*BETA_LETTERS) if ch != "ς")
    return F.regexp_replace(F.translate(F.lower(c), code, greek), r"σ(?![\p{IsGreek}])", "ς")


def words(c: Column) -> Column:
    """Lower-cased runs of letters and apostrophes, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1))


def hash_key(c: Column, n: int = 16) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_accents(F.lower(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def roman(c: Column) -> Column:
    """Value of a Roman numeral by the subtractive rule; null if it is none."""
    table = F.create_map(*[F.lit(x) for kv in ROMAN_NUMBERS.items() for x in kv])
    digits = F.transform(F.split(F.lower(c), ""), lambda x: table[x])
    n = F.size(digits)
    pairs = F.transform(digits, lambda x, i: F.when((i + 1 < n) & (F.get(digits, i + 1) > x), -x).otherwise(x))
    total = F.aggregate(pairs, F.lit(0), lambda a, x: a + x)
    return F.when(F.lower(c).rlike("^[ivxlcdm]+$"), total)


def greek_number(c: Column) -> Column:
    """Sum of the letter values of a Greek numeral; null if other letters occur."""
    table = F.create_map(*[F.lit(x) for kv in GREEK_NUMBERS.items() for x in kv])
    ch = F.split(F.translate(F.lower(c), "ςʹ'", "ϛ"), "")
    return F.aggregate(F.transform(F.filter(ch, lambda x: x != ""), lambda x: table[x]), F.lit(0), lambda a, x: a + x)


def is_greek(c: Column) -> Column:
    return c.rlike(r"\p{IsGreek}")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
