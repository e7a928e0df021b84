"""Joins on order, intervals and ranked keys.

None of them pairs rows beyond its result: as-of joins are one sort, interval joins go
through buckets, and ranked look-ups keep the best hit by an aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, tie: Column | None = None) -> DataFrame:
    """Each left row with the last right ``value`` at or before it; null if there is none.

    Both sides become one stream, sorted within ``by``: one shuffle, no join. Right rows
    at the same place come first; ``tie`` orders equal right rows.
    """
    cols = left.columns
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"))
    b = right.select(*[F.col(c) if c in (*by, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(value).alias("_v"), F.lit(0).alias("_side"), (tie if tie is not None else F.lit(0)).cast("long").alias("_tie"))
    w = Window.partitionBy(*by).orderBy(on, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(w))
    return found.where("_side = 1").select(*cols, f"asof_{value}")


def contains(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Point-in-interval join through buckets of ``width``: an equi-join with a filter, whatever the sizes."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(s, "_b").where(F.col(at).between(F.col(lo), F.col(hi))).drop("_b")


def nearest(points: DataFrame, keys: list[str], at: str, spans: DataFrame, lo: str, hi: str, value: str, order: str, width: int) -> DataFrame:
    """The interval nearest each point among those of its key: distance 0 inside, else the gap; ties go to the first.

    Three candidates suffice: of those that hold the point the first, found through
    buckets of ``width``; the last that ends before it; and the next that begins behind
    it, each of these by one sorted window. ``order`` has to be a number.
    """
    rows = points.withColumn("_id", F.xxhash64(*points.columns)).distinct()
    p = rows.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.col(value).alias("_v"), F.col(order).cast("long").alias("_o"))
    inside = p.join(s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width)))), [*keys, "_b"])
    inside = inside.where(F.col(at).between(F.col("_lo"), F.col("_hi"))).select("_id", F.lit(0).cast("long").alias("_d"), "_o", "_v")
    seen = F.struct("_at", "_o", "_v")

    def beside(edge: str, back: bool) -> DataFrame:
        marks = s.select(*keys, F.col(edge).alias("_at"), F.lit(None).cast("long").alias("_id"), "_o", "_v")
        marks = marks.groupBy(*keys, "_at").agg(F.first("_id").alias("_id"), F.min("_o").alias("_o"), F.min_by("_v", "_o").alias("_v"))
        here = rows.select(*keys, F.col(at).alias("_at"), "_id", F.lit(None).cast("long").alias("_o"), F.lit(None).cast(s.schema["_v"].dataType).alias("_v"))
        w = Window.partitionBy(*keys).orderBy(F.col("_at").asc() if back else F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
        near = marks.unionByName(here).withColumn("_n", F.last(F.when(F.col("_id").isNull(), seen), ignorenulls=True).over(w))
        return near.where("_id is not null and _n is not null").select("_id", F.abs(F.col("_at") - F.col("_n._at")).cast("long").alias("_d"), F.col("_n._o").alias("_o"), F.col("_n._v").alias("_v"))

    found = inside.unionByName(beside("_hi", True)).unionByName(beside("_lo", False))
    best = found.groupBy("_id").agg(F.min(F.struct("_d", "_o", "_v")).alias("_best"))
    return rows.join(best, "_id").select(*points.columns, F.col("_best._v").alias(value), F.col("_best._d").alias("distance"))


def ranked_lookup(keys: DataFrame, key: str, candidates: list[Column], table: DataFrame, on: str, value: str) -> DataFrame:
    """(key, value, rank): the first candidate form of each key that the table has, with its smallest value."""
    tall = keys.select(key, F.posexplode(F.array_distinct(F.array(*candidates))).alias("rank", "_form"))
    hit = tall.join(table.select(F.col(on).alias("_form"), F.col(value).alias("_v")), "_form")
    best = hit.groupBy(key).agg(F.min(F.struct("rank", "_v")).alias("_b"))
    return best.select(key, F.col("_b._v").alias(value), F.col("_b.rank").alias("rank"))


def reconcile(left: DataFrame, right: DataFrame, key: str, allowed: DataFrame) -> DataFrame:
    """(problem, key): keys of one side alone, save the allowed, and allowances that are not needed."""
    l, r, a = (d.select(key).where(F.col(key).isNotNull()).distinct() for d in (left, right, allowed))
    missing, extra = l.join(r, key, "left_anti"), r.join(l, key, "left_anti")
    parts = [("missing", missing.join(a, key, "left_anti")), ("extra", extra.join(a, key, "left_anti")), ("stale allowance", a.join(missing.unionByName(extra), key, "left_anti"))]
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("problem"), key) for n, d in parts])


def expand(spans: DataFrame, lo: str, hi: str, out: str) -> DataFrame:
    """One row for each whole number of each interval."""
    return spans.where(F.col(lo) <= F.col(hi)).withColumn(out, F.explode(F.sequence(lo, hi)))
