"""One consistent form of text whose characters differ but look the same.

Text is cut into positioned pieces: runs that no rule touches, and single clusters of
a code point with its combining marks. The distinct pieces are exploded to positioned
code points, joined with the decomposition and look-alike tables, their marks ordered
by combining class, and recomposed; the pieces are then mapped and the strings rebuilt.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

BROADCAST_PIECES = 100_000

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ү": "Y",
    "ѵ": "v", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ϲ": "c", "Ϲ": "C",
    "ϳ": "j", "Ϳ": "J", "υ": "u", "ι": "i", "κ": "k", "χ": "x", "γ": "y",
    # Cyrillic letters that look like a Greek one
    "Г": "Γ", "П": "Π", "Ф": "Φ", "ф": "φ", "л": "λ",
    # Armenian, Latin extensions
    "օ": "o", "ս": "u", "ց": "g", "ո": "n", "հ": "h", "ɑ": "a", "ɡ": "g", "ı": "i", "ꞵ": "β",
    # hyphens of the same length
    "‐": "-", "‑": "-",
}
# Compatibility kinds that change the width or joining of a letter, not the letter.
KINDS = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
KEPT = "ſ"


def fold_point(ch: str) -> str | None:
    """The code points that stand for one code point; None: it stands for itself; "": it is not seen."""
    cat = unicodedata.category(ch)
    if cat == "Cf" or "︀" <= ch <= "️" or ch == "͏" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if cat == "Zs":
        return " "
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    d = unicodedata.decomposition(ch)
    if not d or ch in KEPT:
        return None
    head, *rest = d.split()
    if head[0] != "<":
        parts = [chr(int(x, 16)) for x in (head, *rest)]
    elif head in KINDS:
        parts = [chr(int(x, 16)) for x in rest]
        letters = all(unicodedata.category(p)[0] in "LMN" for p in parts)
        if not letters and not (head == "<noBreak>" and cat != "Zs"):
            return None
        if head == "<compat>" and cat[0] not in "LS":
            return None
    else:
        return None
    return "".join(p if (q := fold_point(p)) is None else q for p in parts)


@lru_cache(1)
def tables() -> tuple[list[tuple[str, str]], list[tuple[str, int]], list[tuple[str, str]]]:
    """Decomposition with look-alikes, combining classes, and compositions, over the planes in use."""
    points = [chr(c) for r in ((0x80, 0xD800), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x2F800, 0x2FA20)) for c in range(*r) if not 0xAC00 <= c <= 0xD7A3]
    folds = [(c, q) for c in points if (q := fold_point(c)) is not None and q != c]
    classes = [(c, k) for c in points if (k := unicodedata.combining(c))]
    made: dict[str, str] = {}
    for c in points:
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and len(f := fold_point(c) or "") > 1:
            made.setdefault(f, unicodedata.normalize("NFC", f))
    return folds, classes, [(k, v) for k, v in made.items() if k != v]


@lru_cache(1)
def stable_class() -> str:
    """A regular-expression class of code points that no table touches, over the blocks in daily use.

    Few ranges, as Java tests them one by one; other code points are pieces of their own.
    """
    folds, classes, made = tables()
    back = dict(made)
    out = {c for c, f in folds if back.get(f, f) != c} | {c for c, _ in classes}
    runs: list[list[int]] = []
    for block in ((0x20, 0x7F), (0xC0, 0x180), (0x391, 0x3CF), (0x3041, 0x30FB), (0x4E00, 0xA000)):
        for c in range(*block):
            if chr(c) not in out and unicodedata.category(chr(c))[0] not in "MC":
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
    return r"[\n\t" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def _pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    s = stable_class()
    seen = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"[\p{Cf}\x{FE00}-\x{FE0F}\x{34F}]", "")
    # A run ends before a combining mark, so that its last letter starts the cluster.
    cut = F.regexp_extract_all(seen, F.lit(rf"(?s){s}+(?!\p{{M}})|.\p{{M}}*"), F.lit(0))
    return df.select(key, F.posexplode(cut).alias("pos", "piece"))


def _canon(pieces: DataFrame) -> DataFrame:
    """(piece, form) of distinct pieces: explode, decompose, order marks, recompose."""
    spark = pieces.sparkSession
    folds, classes, made = tables()
    fold = F.broadcast(spark.createDataFrame(folds, "c string, into string"))
    rank = F.broadcast(spark.createDataFrame(classes, "m string, ccc int"))
    back = F.broadcast(spark.createDataFrame(made, "cluster string, whole string"))
    points = pieces.select("piece", F.posexplode(F.split("piece", "")).alias("at", "c")).where("c <> ''")
    points = points.join(fold, "c", "left").select("piece", "at", F.posexplode(F.split(F.coalesce("into", "c"), "")).alias("sub", "d")).where("d <> ''")
    points = points.join(rank, points["d"] == rank["m"], "left").select("piece", "at", "sub", "d", F.coalesce("ccc", F.lit(0)).alias("ccc"))
    ordered = F.array_sort(F.collect_list(F.struct("ccc", "at", "sub", "d")))
    out = points.groupBy("piece").agg(F.concat_ws("", F.transform(ordered, lambda x: x["d"])).alias("cluster"))
    return out.join(back, "cluster", "left").select("piece", F.coalesce("whole", "cluster").alias("form"))


def canonical(df: DataFrame, key: str, text: str, out: str = "canonical") -> DataFrame:
    """(key, text, out) with the consistent form of each text.

    ``key`` has to be unique, null keys are dropped. A null text gives null, an empty
    one, or one of invisible characters alone, the empty string. The form keeps letters,
    case, accents, raised digits, punctuation, hyphens, the number of spaces and line
    breaks (of either kind). Clusters for which no single code point exists stay
    decomposed, with their marks in canonical order. Each text is held as one row's
    pieces, however long it is.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null")
    rows = rows.repartition("k")
    pieces = _pieces(rows, "k", "t")
    odd = pieces.where(~F.col("piece").rlike(f"^{stable_class()}+$")).select("piece").distinct()
    # Distinct clusters are few in any real text: sent to all tasks up to a bound, beyond it joined by a shuffle.
    forms = cut(_canon(odd).where("piece <> form"))
    forms = F.broadcast(forms) if forms.count() <= BROADCAST_PIECES else forms.hint("shuffle_hash")
    mapped = pieces.join(forms, "piece", "left").select("k", F.struct("pos", F.coalesce("form", "piece").alias("s")).alias("x"))
    built = mapped.groupBy("k").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"])).alias("form"))
    return rows.join(built, "k", "left").select(
        F.col("k").alias(key), F.col("t").alias(text), F.when(F.col("t").isNotNull(), F.coalesce("form", F.lit(""))).alias(out)
    )


def same_look(canon: DataFrame, key: str, text: str, form: str = "canonical") -> DataFrame:
    """(id_a, id_b): pairs of records whose strings differ and whose forms are equal.

    Null, empty and invisible texts are no case. Records are first reduced to classes of
    identical strings; only forms with two or more classes go on, and members are
    joined by pair of classes, so that a form with many identical copies costs what it
    returns. AQE splits hot classes.
    """
    recs = canon.where(f"{form} <> ''").select(F.col(key).alias("id"), F.md5(F.col(form)).alias("look"), F.md5(F.col(text)).alias("str"))
    kinds = recs.groupBy("look", "str").agg(F.count(F.lit(1)).alias("n"))
    mixed = kinds.groupBy("look").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("look")
    few = recs.join(mixed, "look", "left_semi")
    kinds = kinds.join(mixed, "look", "left_semi").select("look", "str")
    pairs = kinds.select("look", F.col("str").alias("str_a")).join(kinds.select("look", F.col("str").alias("str_b")), "look").where("str_a < str_b").select("str_a", "str_b")
    a = few.select(F.col("str").alias("str_a"), F.col("id").alias("a"))
    b = few.select(F.col("str").alias("str_b"), F.col("id").alias("b"))
    return pairs.join(a, "str_a").join(b, "str_b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def look_classes(canon: DataFrame, key: str, text: str, form: str = "canonical") -> DataFrame:
    """(key, look, n_records, n_strings) of every record that looks like one with another string.

    The same cases as ``same_look`` as classes and their members: one row for each record,
    however many look alike.
    """
    recs = canon.where(f"{form} <> ''").select(F.col(key).alias("id"), F.md5(F.col(form)).alias("look"), F.md5(F.col(text)).alias("str"))
    kinds = recs.groupBy("look", "str").agg(F.count(F.lit(1)).alias("n"))
    mixed = kinds.groupBy("look").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_strings")).where("n_strings > 1")
    return recs.join(mixed, "look").select(F.col("id").alias(key), "look", "n_records", "n_strings")


def sources(spark: SparkSession, fragments: DataFrame, gsents: DataFrame) -> dict[str, DataFrame]:
    from .common import latest

    return {
        "fragments": latest(fragments, "frag_id", "fetched_at", ["text"]).select(F.col("frag_id").alias("id"), "text"),
        "gsents": latest(gsents, "sent_id", "loaded_at", ["text"]).select(F.col("sent_id").alias("id"), "text"),
    }


def found(spark: SparkSession, fragments: DataFrame, gsents: DataFrame) -> DataFrame:
    from functools import reduce

    parts = []
    for name, df in sources(spark, fragments, gsents).items():
        form = cut(canonical(df, "id", "text").select("id", "text", "canonical"))
        parts.append(same_look(form, "id", "text").select(F.lit(name).alias("src"), "id_a", "id_b"))
    return reduce(DataFrame.unionByName, parts)


def forms(spark: SparkSession, fragments: DataFrame, gsents: DataFrame) -> DataFrame:
    from functools import reduce

    return reduce(
        DataFrame.unionByName,
        [canonical(df, "id", "text").select(F.lit(name).alias("src"), "id", "canonical") for name, df in sources(spark, fragments, gsents).items()],
    )
