"""Checks as problem tables: no row means no problem; strict mode raises at the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(df: DataFrame, check: str, bad: Column, subject: Column) -> DataFrame:
    """(check_name, subject) of rows for which ``bad`` holds; null counts as no problem."""
    return df.where(bad).select(F.lit(check).alias("check_name"), subject.cast("string").alias("subject"))


def suite(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def strict(found: DataFrame) -> DataFrame:
    return found.withColumn("subject", F.raise_error(F.concat_ws(": ", "check_name", "subject")))


def duplicates(df: DataFrame, key: list[str], check: str) -> DataFrame:
    return problems(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), check, F.col("n") > 1, F.concat_ws("/", *[F.col(k).cast("string") for k in key]))


def missing(df: DataFrame, key: str, known: DataFrame, on: str, check: str) -> DataFrame:
    k = known.select(F.col(on).alias(key)).distinct()
    return problems(df.where(F.col(key).isNotNull()).select(key).distinct().join(k, key, "left_anti"), check, F.lit(True), F.col(key))
