"""Positional inverted index and searches over it.

The index is a tall table (seg, pos, term). ``write_index`` clusters it by term, so that
a search of the stored index prunes to its terms; no posting list is ever one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import words


def postings(df: DataFrame, seg: str, text: str, keep: list[str] | None = None, terms=words) -> DataFrame:
    """(seg, keep..., pos, term): every word of every segment, positions from 0; ``keep`` spares a later join for them."""
    return df.select(F.col(seg).alias("seg"), *(keep or []), F.posexplode(terms(F.col(text))).alias("pos", "term"))


def write_index(index: DataFrame, path: str) -> None:
    """The index clustered by term: ranges of terms by file, sorted within, so that a search reads few row groups."""
    index.repartitionByRange("term").sortWithinPartitions("term", "seg", "pos").write.mode("overwrite").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _match(term: str) -> Column:
    return F.col("term").startswith(term[:-1]) if term.endswith("*") else F.col("term") == term


def search_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """Segments that hold every term; a trailing * asks for a prefix."""
    hits = [F.max(_match(t).cast("int")).alias(f"h{i}") for i, t in enumerate(terms)]
    found = index.where(reduce(Column.__or__, map(_match, terms))).groupBy("seg").agg(*hits)
    return found.where(reduce(Column.__and__, [F.col(f"h{i}") == 1 for i in range(len(terms))])).select("seg")


def search_any(index: DataFrame, terms: list[str]) -> DataFrame:
    return index.where(reduce(Column.__or__, map(_match, terms))).select("seg").distinct()


def search_phrase(index: DataFrame, terms: list[str]) -> DataFrame:
    """(seg, pos): places where the terms follow one another.

    Each occurrence votes for the start it would belong to, so one aggregation on
    (seg, start) answers a phrase of any length, without a self-join.
    """
    starts = F.array_compact(F.array(*[F.when(_match(t), F.struct((F.col("pos") - i).alias("pos"), F.lit(i).alias("slot"))) for i, t in enumerate(terms)]))
    votes = index.where(reduce(Column.__or__, map(_match, terms))).select("seg", F.explode(starts).alias("v"))
    return votes.groupBy("seg", F.col("v.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == len(terms)) & (F.col("pos") >= 0)).select("seg", "pos")


def hit_positions(index: DataFrame, terms: list[str]) -> DataFrame:
    """(seg, n, positions): sorted places of any of the terms."""
    found = index.where(reduce(Column.__or__, map(_match, terms)))
    return found.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("pos")).alias("positions"))


def kwic(df: DataFrame, seg: str, text: str, phrase: list[str], window: int = 8) -> DataFrame:
    """(seg, pos, left, hit, right): each place of a phrase with the words about it, cut where it is found."""
    toks = df.select(F.col(seg).alias("seg"), words(F.col(text)).alias("w"))
    at, length = F.col("pos") + 1, len(phrase)
    hits = toks.select("seg", "w", F.explode(F.filter(F.transform("w", lambda _, i: F.when(reduce(Column.__and__, [F.get("w", i + k) == t for k, t in enumerate(phrase)]), i)), lambda x: x.isNotNull())).alias("pos"))
    left = F.slice("w", F.greatest(F.lit(1), at - window), at - F.greatest(F.lit(1), at - window))
    return hits.select(
        "seg", "pos", F.array_join(left, " ").alias("left"),
        F.array_join(F.slice("w", at, F.lit(length)), " ").alias("hit"),
        F.array_join(F.slice("w", at + length, F.lit(window)), " ").alias("right"),
    )


def kwic_chars(df: DataFrame, seg: str, text: str, needle: str, width: int = 40) -> DataFrame:
    """(seg, at, snippet): the first occurrence of a string with ``width`` characters on each side."""
    at = F.instr(F.col(text), needle)
    found = df.select(F.col(seg).alias("seg"), F.col(text).alias("t"), at.alias("at")).where("at > 0")
    start = F.greatest(F.lit(1), F.col("at") - width)
    return found.select("seg", "at", F.substring("t", start, F.col("at") + len(needle) + width - start).alias("snippet"))


def rollup_terms(index: DataFrame, least: int = 3) -> DataFrame:
    """(term, owner, n) of an index that keeps ``owner``, with subtotals: n by term and owner, and over all owners (owner null)."""
    tall = index.groupBy("term", "owner").agg(F.count(F.lit(1)).alias("n"))
    return tall.rollup("term", "owner").agg(F.sum("n").alias("n")).where(f"term is not null and n >= {least}")
