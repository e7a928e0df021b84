"""Lexicon keys and their variants, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import BETA_LETTERS, BETA_MARKS, collapse, strip_accents

# Latin words that end like an enclitic but hold none; the enclitics.
WHOLE_WORDS = ("atque", "neque", "itaque", "absque", "denique", "undique", "utique", "quoque", "namque", "plerumque", "ubique")
ENCLITICS = ("que", "ne", "ve")
# Letters that only numerals use, and the sign behind a numeral.
NUMERAL_SIGNS, KERAIA, APOSTROPHES = "ϛϟϡʹ͵", "ʹ'’", "'’᾽ʼ"


@lru_cache(1)
def beta_table() -> dict[str, str]:
    """Beta Code of each Greek letter with its marks, of marks that stand alone, and of apostrophes."""
    letters = dict(zip(*BETA_LETTERS))
    out = dict(BETA_MARKS) | dict.fromkeys(APOSTROPHES, "'")
    for c in (*range(0x370, 0x400), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(c).lower())
        if base in letters and all(m in BETA_MARKS for m in marks):
            out[chr(c)] = letters[base] + "".join(BETA_MARKS[m] for m in marks)
    return out


def beta_key(c: Column, strict: bool = False) -> Column:
    """Beta Code with breathings and accents: grave as acute, a second accent dropped.

    A character without a code gives null, or an error if ``strict``. Null stays null.
    """
    table = F.create_map(*[F.lit(x) for kv in beta_table().items() for x in kv])
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.element_at(table, x))
    key = F.regexp_replace(F.array_join(codes, ""), r"^(.*[/=].*)[/=]", "$1")
    bad = F.raise_error(F.concat(F.lit("no Beta Code for a character of "), c)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.exists(codes, lambda x: x.isNull()), bad).otherwise(key)


def capital_key(key: Column) -> Column:
    """The form under which names stand: a star, and the first letter's marks before it."""
    return F.when(key.rlike("^[a-z]"), F.regexp_replace(key, r"^([a-z])([()/=+|]*)", "*$2$1")).otherwise(F.concat(F.lit("*"), key))


def greek_variants(key: Column, capital: Column) -> Column:
    """Keys to try in order: as it is, a diaeresis left out or as either breathing, then all of these as names."""
    plus = F.when(F.contains(key, F.lit("+")), F.transform(F.array(F.lit(""), F.lit("("), F.lit(")")), lambda x: F.replace(key, F.lit("+"), x))).otherwise(F.array().cast("array<string>"))
    plain = F.concat(F.array(key), plus)
    return F.when(capital, F.concat(plain, F.transform(plain, capital_key))).otherwise(plain)


def latin_key(c: Column) -> Column:
    return F.lower(c)


def enclitic_hosts(key: Column) -> Column:
    """What remains before each enclitic that a word may end with: two letters at least, words known to hold none left alone."""
    hosts = [F.when(key.endswith(e) & (F.length(key) - len(e) >= 2), F.substring(key, F.lit(1), F.length(key) - len(e))) for e in ENCLITICS]
    return F.when(key.isin(*WHOLE_WORDS), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*hosts)))


def latin_variants(key: Column, capital: Column) -> Column:
    """Keys to try in order: the whole form, its hosts, then all of these with a first capital."""
    plain = F.concat(F.array(key), enclitic_hosts(key))
    upper = F.transform(plain, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2))))
    return F.array_distinct(F.when(capital, F.concat(plain, upper)).otherwise(plain))


def base_key(c: Column) -> Column:
    """A dictionary key without homonym numbers, quantities and hyphens."""
    return F.regexp_replace(c, r"[0-9_^#-]", "")


def fold_key(c: Column) -> Column:
    return F.regexp_replace(base_key(c), r"[/\\=+]", "")


def lemma_candidates(lemma: Column) -> Column:
    """(index, key) look-ups of a lemma in order: exact, base, folded, then forms that dictionaries head otherwise."""
    fold = fold_key(lemma)

    def at(index: str, key: Column) -> Column:
        return F.struct(F.lit(index).alias("index"), key.alias("key"))

    adverb = F.when(fold.endswith("ws"), at("fold", F.regexp_replace(fold, "ws$", "hs")))
    verbal = F.when(fold.endswith("teos"), at("fold", F.regexp_replace(fold, "teos$", "teon")))
    return F.array_compact(F.array(at("exact", lemma), at("base", base_key(lemma)), at("fold", fold), adverb, verbal))


def edition_norm(c: Column) -> Column:
    """Letters and single spaces alone, without accents, in lower case: how editions are compared."""
    return collapse(F.regexp_replace(F.translate(strip_accents(F.lower(c)), "ς", "σ"), r"[^\p{L}\s]+", ""))


def accent_key(c: Column) -> Column:
    """For comparison with accents: lower case, final sigma as any other."""
    return F.translate(F.lower(c), "ς", "σ")


def gloss_norm(c: Column) -> Column:
    return F.regexp_replace(collapse(F.lower(c)), r"[\s\p{P}]+$", "")


def is_greek_numeral(c: Column) -> Column:
    """Whether a whole token is a numeral: it holds a sign that only numerals have, and value letters besides."""
    return c.rlike(f"[{NUMERAL_SIGNS}]") & c.rlike(f"^͵?[α-ωϛϟϡ]+[{KERAIA}]?$")


def peel(c: Column) -> Column:
    """A token without edge punctuation; an apostrophe stays only behind a letter, as an elision."""
    edges = F.regexp_replace(c, r"^[\p{P}\p{S}&&[^'’᾽ʼ]]+|[\p{P}\p{S}&&[^'’᾽ʼ]]+$", "")
    quotes = F.regexp_replace(edges, r"(?<![\p{L}\p{M}])['’᾽ʼ][\p{P}\p{S}]*$", "")
    return F.regexp_replace(F.regexp_replace(quotes, r"^['’᾽ʼ]+(?=\p{L})", ""), r"[\p{P}\p{S}&&[^'’᾽ʼ]]+$", "")
