"""Mixing sources to target shares by entropy balancing.

Each record i of source s with t tokens gets a rate w in (0, m), m the source's cap.
The rates minimise the bounded relative entropy to the base rate q under the token
constraint of each source; the minimiser is an exponential tilt
``w = m q e^(x t) / (m - q + q e^(x t))`` whose x per source solves a convex dual, by
Newton steps over distributed sums. A rate depends on source and size alone, so the
sums run over the counts of each (source, size). Rates become whole copies by
systematic rounding along the records of a source in order of size, so that the
tokens really used follow the tokens asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut
from .tokens import VOCABULARY, count

MAX_SOURCES = 10_000
STEPS = 60
TOLERANCE = 1e-9
SALTS = 32


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return count(documents.select("doc_id", "source", "text"), ["doc_id", "source"], "text", vocabulary)


def _targets(targets: DataFrame) -> list[dict]:
    """One row for each source; shares are scaled to a sum of 1. A null or negative share counts as 0."""
    best: dict[str, dict] = {}
    for r in bounded(targets.select("source", "target_share", "max_repeats").where("source is not null"), MAX_SOURCES, "mix targets"):
        share, cap = max(0.0, r["target_share"] or 0.0), max(0, r["max_repeats"] if r["max_repeats"] is not None else 1)
        best[r["source"]] = max(best.get(r["source"], {"share": -1}), {"source": r["source"], "share": share, "cap": cap}, key=lambda x: x["share"])
    total = sum(x["share"] for x in best.values())
    return [x | {"share": x["share"] / total if total else 0.0} for x in sorted(best.values(), key=lambda x: x["source"])]


def _rate(x, t, cap, base):
    z = F.least(F.lit(700.0), F.greatest(F.lit(-700.0), x * t))
    e = F.exp(z)
    return cap * base * e / (cap - base + base * e)


def solve(sized: DataFrame, targets: DataFrame) -> tuple[list[dict], DataFrame]:
    """The tilt of each source, and the histogram (source, n_tokens, n) that it was found on."""
    spark = sized.sparkSession
    plan = _targets(targets)
    hist = cut(
        sized.where("source is not null and n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    )
    have = {
        r["source"]: r
        for r in hist.join(F.broadcast(spark.createDataFrame([(p["source"],) for p in plan], "source string")), "source")
        .groupBy("source")
        .agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("records"))
        .collect()
    } if plan else {}
    plan = [p | {"tokens": int(have[p["source"]]["tokens"]) if p["source"] in have else 0, "records": int(have[p["source"]]["records"]) if p["source"] in have else 0} for p in plan]
    # The largest total for which every source with tokens can reach its share.
    open_ = [p for p in plan if p["share"] > 0 and p["tokens"] * p["cap"] > 0]
    covered = sum(p["share"] for p in open_)
    total = min((p["tokens"] * p["cap"] / (p["share"] / covered) for p in open_), default=0.0)
    for p in plan:
        p["goal"] = total * p["share"] / covered if p in open_ else 0.0
        top = p["tokens"] * p["cap"]
        mean = p["tokens"] / p["records"] if p["records"] else 1.0
        p["full"] = bool(top) and p["goal"] >= top * (1 - 1e-9)
        p["base"] = min(1.0, p["cap"] / 2) or 0.5
        p["unit"], p["x"], p["done"] = mean, 0.0, p["goal"] == 0 or p["full"]
    for _ in range(STEPS + 1):
        live = [p for p in plan if not p["done"]]
        if not live:
            break
        now = F.broadcast(
            spark.createDataFrame([(p["source"], p["x"], float(p["cap"]), p["base"], p["unit"]) for p in live], "source string, x double, cap double, base double, unit double")
        )
        t = F.col("n_tokens") / F.col("unit")
        w = _rate(F.col("x"), t, F.col("cap"), F.col("base"))
        sums = {
            r["source"]: r
            for r in hist.join(now, "source")
            .withColumn("w", w)
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("w") * F.col("n_tokens")).alias("got"),
                F.sum(F.col("n") * F.col("w") * (1 - F.col("w") / F.col("cap")) * F.col("n_tokens") * t).alias("slope"),
            )
            .collect()
        }
        for p in live:
            gap = p["goal"] - sums[p["source"]]["got"]
            slope = sums[p["source"]]["slope"]
            p["done"] = abs(gap) <= TOLERANCE * p["goal"]
            # A damped step: far from the solution the dual is nearly flat.
            step = gap / slope if slope > 0 else math.copysign(1.0, gap)
            p["x"] += max(-2.0, min(2.0, step)) if not p["done"] else 0.0
    if open_sources := [p["source"] for p in plan if not p["done"]]:
        raise ArithmeticError(f"no tilt found within {STEPS} steps for {open_sources}")
    return plan, hist


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies int): how often each record is used.

    Copies are whole numbers from 0 to the source's cap. Null and empty texts have no
    tokens and 0 copies, as have records whose source is null or has no target. A
    source whose goal takes all it has gets its cap for every record. A target source
    without records can't reach its share; the others then share the total in
    proportion. Tied sizes are ordered by a hash of doc_id. A doc_id that comes
    twice is rounded once for each row.
    """
    sized = cut(sizes(documents, vocabulary))
    plan, _ = solve(sized, targets)
    spark = sized.sparkSession
    know = spark.createDataFrame(
        [(p["source"], p["x"], float(p["cap"]), p["base"], p["unit"], p["goal"], p["full"]) for p in plan],
        "source string, x double, cap double, base double, unit double, goal double, full boolean",
    )
    w = F.when(F.col("goal").isNull() | (F.col("goal") == 0) | (F.col("n_tokens") == 0), F.lit(0.0)).when(F.col("full"), F.col("cap")).otherwise(
        _rate(F.col("x"), F.col("n_tokens") / F.col("unit"), F.col("cap"), F.col("base"))
    )
    rated = sized.join(F.broadcast(know), "source", "left").select("doc_id", "source", "n_tokens", w.alias("rate"), F.col("cap"))
    # Systematic rounding: a source may hold a third of all rows, so its running sums are
    # taken within (source, size class, salt), after the sums of the classes before.
    rated = (
        rated.withColumn("part", F.col("rate") - F.floor("rate"))
        .withColumn("class", F.floor(F.log2(F.col("n_tokens") + 1) * 16))
        .withColumn("h", F.xxhash64("doc_id"))
        .withColumn("salt", F.pmod("h", F.lit(SALTS)))
    )
    cells = rated.groupBy("source", "class", "salt").agg(F.sum("part").alias("mass"))
    before = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("mass").over(before), F.lit(0.0))).drop("mass")
    inside = Window.partitionBy("source", "class", "salt").orderBy("n_tokens", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = rated.withColumn("upto", F.sum("part").over(inside)).join(
        cells.select(F.col("source").alias("s2"), F.col("class").alias("c2"), F.col("salt").alias("z2"), "start"),
        F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2")) & (F.col("salt") == F.col("z2")),
    )
    end = F.col("start") + F.col("upto") + F.lit(0.5 + 1e-9)
    copies = F.floor("rate") + F.floor(end) - F.floor(end - F.col("part"))
    return run.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), F.least(copies, F.coalesce("cap", F.lit(0.0))).cast("int").alias("copies"))


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each source, or none: the target, what there is, what is used, and the share really reached."""
    used = (
        mix(documents, targets, vocabulary)
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n_records"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"),
            F.sum("copies").alias("used_copies"),
            F.max("copies").alias("most_repeats"),
        )
    )
    goal = documents.sparkSession.createDataFrame([(p["source"], p["share"], p["cap"]) for p in _targets(targets)], "s string, target_share double, max_repeats int")
    out = used.join(F.broadcast(goal), F.col("source") == F.col("s"), "full").withColumn("source", F.coalesce("source", "s")).drop("s")
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return out.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "n_tokens", "used_tokens", "used_copies", "most_repeats")],
        F.round(F.coalesce(F.try_divide(F.col("used_tokens"), total), F.lit(0.0)), 6).alias("actual_share"),
    )
