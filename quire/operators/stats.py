"""Robust statistics, summaries and inventories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robust_z(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(x - median) / scale: 1.4826 times the median deviation, else the deviation, else 1. Two aggregates, joined on small sides."""
    mid = df.groupBy(*by).agg(F.median(x).alias("med"), F.stddev_pop(x).alias("sd"))
    d = df.join(mid, by)
    dev = d.groupBy(*by).agg(F.median(F.abs(F.col(x) - F.col("med"))).alias("mad"))
    scale = F.coalesce(F.nullif(F.col("mad") * 1.4826, F.lit(0.0)), F.nullif(F.col("sd"), F.lit(0.0)), F.lit(1.0))
    return d.join(dev, by).withColumn("z", (F.col(x) - F.col("med")) / scale)


def outliers(df: DataFrame, by: list[str], x: str, limit: float = 1.5) -> DataFrame:
    m = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    return df.join(m, by).where(F.abs(F.col(x) - F.col("mean")) > limit * F.col("sd"))


def mode_first(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals, that seen first."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    return n.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_o"))).alias("_b")).select(*by, F.col(f"_b.{value}").alias(value), F.col("_b.n").alias("n"))


def char_inventory(df: DataFrame, text: str, expected: str) -> DataFrame:
    """(ch, n): characters outside a regular-expression class; counted per row first."""
    odd = F.regexp_extract_all(F.col(text), F.lit(f"[^{expected}]"), F.lit(0))
    return df.select(F.explode(odd).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, by: str, x: str, exact: Column) -> DataFrame:
    """n, mean, median, greatest and share of exact rows, by group and over all (group null)."""
    return df.groupingSets([[F.col(by)], []], F.col(by)).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.median(x), 4).alias("median"), F.max(x).alias("most"), F.round(F.avg(exact.cast("double")), 4).alias("exact_share")
    )


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group; Spark keeps k rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def tfidf(index: DataFrame) -> DataFrame:
    """(seg, term, w): tf by length, idf ln((n + 1) / (df + 1)) + 1, unit length per segment.

    One aggregate by segment and term; lengths and norms are sums within a segment.
    """
    seg = Window.partitionBy("seg")
    tf = index.groupBy("seg", "term").agg(F.count(F.lit(1)).alias("c"))
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = tf.agg(F.countDistinct("seg").alias("total"))
    w = tf.withColumn("len", F.sum("c").over(seg)).join(df_, "term").crossJoin(F.broadcast(total))  # one row
    w = w.withColumn("w", F.col("c") / F.col("len") * (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1))
    return w.select("seg", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(seg))).alias("w"))


def neighbours(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, rows: int = 4096, asked: int = 512) -> DataFrame:
    """(q, key, sim): for each query the ``k`` rows of greatest cosine, itself left out; ties (to 4 places) by key.

    Exact: a stated set of queries against all rows, in blocks of a bounded number of
    vectors, each pair of blocks one matrix product of which only the best go on. Null and
    zero vectors have no neighbours.
    """

    def blocks(x: DataFrame, size: int, ids: str, vecs: str) -> DataFrame:
        x = x.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        n = max(1, -(-x.count() // size))
        return x.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("b")).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))).alias("x")).select(F.transform("x", lambda y: y["k"]).alias(ids), F.flatten(F.transform("x", lambda y: y["v"])).alias(vecs))

    def unit(ids, flat) -> np.ndarray:
        m = np.asarray(flat, dtype=float).reshape(len(ids), -1)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def run(batches):
        for b in batches:
            out = []
            for qi, qv, ki, kv in zip(b["qi"], b["qv"], b["ki"], b["kv"]):
                sims, ki = unit(qi, qv) @ unit(ki, kv).T, np.asarray(ki)
                for q, row in zip(qi, sims):
                    for i in np.lexsort((ki, -np.round(row, 4)))[: k + 1]:
                        if ki[i] != q and row[i]:
                            out.append((q, ki[i], float(row[i])))
            yield pd.DataFrame(out, columns=["q", "k", "sim"])

    pairs = blocks(df, rows, "ki", "kv").crossJoin(blocks(queries, asked, "qi", "qv"))
    near = pairs.mapInPandas(run, "q long, k long, sim double")
    return top_k(near, ["q"], [F.round("sim", 4).desc(), F.col("k")], k).select("q", F.col("k").alias(key), "sim")
