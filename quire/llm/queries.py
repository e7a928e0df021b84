"""Named queries of the training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, bitext, lookalike, mixing, scans, sentences, tokens, turns
from .common import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.found(table(spark, sf_dir, "chapter_refs"), table(spark, sf_dir, "gsents"), table(spark, sf_dir, "analyses"))


def _scans(spark: SparkSession, sf_dir: str):
    sources = {k: cut(v) for k, v in scans.inputs(*[table(spark, sf_dir, t) for t in ("break_hits", "footnote_defs", "corrections")]).items()}
    return sources, scans.train(sources, table(spark, sf_dir, "documents"), table(spark, sf_dir, "works"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(*_scans(spark, sf_dir))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(*_scans(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.found(table(spark, sf_dir, "gsents"))


def _both_turns(spark: SparkSession, sf_dir: str, made) -> DataFrame:
    inputs = turns.inputs(table(spark, sf_dir, "new_turns"), table(spark, sf_dir, "ref_turns"))
    roster = table(spark, sf_dir, "speakers")
    return reduce(DataFrame.unionByName, [made(df, roster).select(F.lit(src).alias("src"), "*") for src, df in inputs.items()])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_turns(spark, sf_dir, turns.found)


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_turns(spark, sf_dir, turns.clean_turns)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.found(spark, table(spark, sf_dir, "fragments"), table(spark, sf_dir, "gsents"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.forms(spark, table(spark, sf_dir, "fragments"), table(spark, sf_dir, "gsents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_repaired, p3_found, p4_found, p4_turns, p5_found, p5_forms, p6_ids, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)}
SQL: dict[str, str] = {}
