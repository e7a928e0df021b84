"""Interpolation, slicing and evidence over offsets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolate(knots: DataFrame, points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Each point's y between the knots on both sides, linear; beyond them the nearest knot's.

    One stream of knots and points sorted within ``by``; no join.
    """
    k = knots.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(0).alias("_side"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (*by,)])
    p = points.select(*by, F.col(x).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_side"), *[c for c in points.columns if c not in (*by,)])
    knot = F.when(F.col("_side") == 0, F.struct("_x", "_y"))
    w = Window.partitionBy(*by).orderBy("_x", "_side")
    before = F.last(knot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(knot, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = k.unionByName(p).withColumn("_b", before).withColumn("_a", after).where("_side = 1")
    dx = F.col("_a._x") - F.col("_b._x")
    line = F.col("_b._y") + (F.col("_x") - F.col("_b._x")) * (F.col("_a._y") - F.col("_b._y")) / F.nullif(dx, F.lit(0.0))
    return both.select(*points.columns, F.coalesce(line, F.col("_b._y"), F.col("_a._y")).alias(f"{y}_at"))


def snap_to_word(text: Column, at: Column) -> Column:
    """The start of the word nearest an offset (0-based), the earlier one on ties; texts of any length."""
    # Tried at word starts alone: the time stays linear in long texts without spaces.
    left = F.length(F.regexp_replace(F.substring(text, F.lit(1), at), r"(?<!\S)\S*$", ""))
    right = at + F.length(F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"^\S*\s*", 0))
    return F.when(F.substring(text, at, F.lit(1)).rlike(r"^\s$") | (at == 0), at).when(at - left <= right - at, left).otherwise(right)


def disjoint(df: DataFrame, by: str, lo: str, hi: str) -> DataFrame:
    """(by, n): most intervals of a group that do not overlap, by earliest end; closed ends, those with a null end not counted.

    One pass over runs sorted by end, so that a group of any size holds no more than one batch.
    """

    def run(batches):
        key, n, end, any_ = None, 0, None, False
        for b in batches:
            ks, ns = [], []
            for k, a, z in zip(*[c.to_pylist() for c in b.columns]):
                if not any_ or k != key:
                    if any_:
                        ks.append(key)
                        ns.append(n)
                    key, n, end, any_ = k, 0, None, True
                if a is not None and z is not None and (end is None or a > end):
                    n, end = n + 1, z
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(ks, b.column(0).type), pa.array(ns, pa.int64())], ["g", "n"])
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([key], b.column(0).type), pa.array([n], pa.int64())], ["g", "n"])

    kind = df.schema[by].dataType.simpleString()
    runs = df.select(by, lo, hi).repartition(by).sortWithinPartitions(by, hi, lo)
    return runs.mapInArrow(run, f"g {kind}, n long").withColumnRenamed("g", by)
