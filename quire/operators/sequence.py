"""Operators over ordered rows: gaps, blocks, ranges and carried labels, each one window pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """(by, after, next): neighbours that are not consecutive numbers."""
    w = Window.partitionBy(*by).orderBy(n)
    return df.select(*by, n).distinct().withColumn("next", F.lead(n).over(w)).where(F.col("next") > F.col(n) + 1).select(*by, F.col(n).alias("after"), "next")


def out_of_order(df: DataFrame, by: list[str], order: list[str], key: str, width: int = 4096) -> DataFrame:
    """Rows whose key lies below the greatest key before them: transposed stretches.

    ``order`` begins with a whole number; a group is cut into blocks of ``width`` of it, so
    that a hot group's rows are spread: each block takes over the greatest key of the
    blocks before it. ``by`` must not be null.
    """
    rows = df.withColumn("_b", F.floor(F.col(order[0]) / width))
    tops = rows.groupBy(*by, "_b").agg(F.max(key).alias("_top"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "_b", F.max("_top").over(before).alias("_top"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.max(key).over(inside)).join(tops, [*by, "_b"])
    high = F.greatest("_in", "_top")
    return rows.withColumn("high", high).where(F.col(key) < F.col("high")).drop("_b", "_in", "_top")


def ranges(df: DataFrame, by: list[str], start: str, last: Column) -> DataFrame:
    """Each row's range: up to one before the next start, the last one up to ``last``."""
    w = Window.partitionBy(*by).orderBy(start)
    return df.withColumn("range_end", F.coalesce(F.lead(start).over(w) - 1, last))


def carry(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """The label in force at each row, and whether it is shown: not where it repeats the last one."""
    w = Window.partitionBy(*by).orderBy(*order)
    held = df.withColumn("held", F.last(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return held.withColumn("shown", F.col("held").isNotNull() & ~F.coalesce(F.col("held") == F.lag("held").over(w), F.lit(False)))


def islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, value, first, last, n): runs of equal values in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    runs = df.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min(F.struct(*order)), F.max(F.struct(*order))
    return runs.groupBy(*by, "_run").agg(F.first(value).alias(value), first.alias("_f"), last.alias("_l"), F.count(F.lit(1)).alias("n")).select(
        *by, value, F.col("_f")[order[0]].alias("first"), F.col("_l")[order[0]].alias("last"), "n"
    )


def coverage(spans: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """(by, at, depth): where the number of covering intervals changes, by a sweep; never one row per number."""
    events = spans.select(*by, F.col(lo).alias("at"), F.lit(1).alias("d")).unionByName(spans.select(*by, (F.col(hi) + 1).alias("at"), F.lit(-1).alias("d")))
    steps = events.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    return steps.select(*by, "at", F.sum("d").over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))


def sessions(df: DataFrame, by: list[str], order: list[str], marker: Column) -> DataFrame:
    """A running number of the section each row belongs to, sections beginning at markers."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section", F.sum(marker.cast("int")).over(w))


def unique_names(df: DataFrame, name: str, rank: list[Column]) -> DataFrame:
    """Names made unique by -2, -3, ... in order of rank."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*rank))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat_ws("-", name, n)))


def rejoin_hyphens(lines: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """A line's final hyphen closed up with the next line's first word, which then leaves that line."""
    w = Window.partitionBy(*by).orderBy(order)
    parted = F.col(text).rlike(r"[A-Za-z]-$")
    head = F.substring_index(F.lead(text).over(w), " ", 1)
    took = F.coalesce(F.lag(parted).over(w), F.lit(False))
    rest = F.when(took, F.when(F.instr(text, " ") > 0, F.expr(f"substring({text}, instr({text}, ' ') + 1)")).otherwise("")).otherwise(F.col(text))
    healed = F.when(parted & F.lead(text).over(w).isNotNull(), F.concat(F.regexp_replace(rest, "-$", ""), head)).otherwise(rest)
    return lines.withColumn("healed", healed)
