"""Keyed merges with precedence, differences, and release decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, key: str, value: str, wins: str = "old") -> DataFrame:
    """(key, value, status): union by key; where both have one that differs, ``wins`` decides."""
    o = old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_ho"))
    n = new.select(key, F.col(value).alias("_n"), F.lit(True).alias("_hn"))
    both = F.col("_ho") & F.col("_hn")
    first, second = ("_o", "_n") if wins == "old" else ("_n", "_o")
    flag = "_ho" if wins == "old" else "_hn"
    status = F.when(F.col("_ho").isNull(), "added").when(F.col("_hn").isNull(), "kept").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("conflict")
    return o.join(n, key, "full").select(key, F.when(F.col(flag), F.col(first)).otherwise(F.col(second)).alias(value), status.alias("status"))


def last_writer(df: DataFrame, key: str, rank: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*rank))).where("_r = 1").drop("_r")


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): identical, changed, removed or added."""
    o, n = old.select(key, F.col(digest).alias("_o")), new.select(key, F.col(digest).alias("_n"))
    state = F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "added").when(F.col("_o") == F.col("_n"), "identical").otherwise("changed")
    return o.join(n, key, "full").select(key, state.alias("state"))


def decision(changes: DataFrame) -> DataFrame:
    """noop, upload, or refuse where anything published would go or change."""
    n = changes.agg(*[F.coalesce(F.sum((F.col("state") == s).cast("long")), F.lit(0)).alias(s) for s in ("identical", "changed", "removed", "added")])
    return n.select("*", F.when(F.col("changed") + F.col("removed") > 0, "refuse").when(F.col("added") > 0, "upload").otherwise("noop").alias("decision"))


def revisions(log: DataFrame, by: list[str], order: list[str], rev: str) -> DataFrame:
    """write, idempotent or reject: a revision counts only above the greatest before it."""
    high = F.max(rev).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("outcome", F.when(high.isNull() | (F.col(rev) > high), "write").when(F.col(rev) == high, "idempotent").otherwise("reject"))


def resolve_chain(links: DataFrame, key: str, parent: str, depth: int = 8) -> DataFrame:
    """(key, root, hops): the end of each chain of references by pointer jumping, each round doubling the reach.

    Chains beyond 2 ** depth and cycles have a null root.
    """
    cur = links.select(F.col(key).alias("k"), F.coalesce(parent, key).alias("p"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("h"))
    for _ in range(depth):
        nxt = cur.select(F.col("k").alias("_k"), F.col("p").alias("_p"), F.col("h").alias("_h"))
        cur = cur.join(nxt, cur["p"] == nxt["_k"], "left").select("k", F.coalesce("_p", "p").alias("p"), (F.col("h") + F.when(F.col("p") == F.col("k"), 0).otherwise(F.coalesce("_h", F.lit(0)))).alias("h"))
    ends = links.where(F.col(parent).isNull()).select(F.col(key).alias("_e"))
    return cur.join(ends, cur["p"] == ends["_e"], "left").select(F.col("k").alias(key), F.col("_e").alias("root"), F.when(F.col("_e").isNotNull(), F.col("h")).alias("hops"))


def port(df: DataFrame, key: str, scope: str, at: str, source: str) -> DataFrame:
    """(key, root, hops, state): the places at whose end a record's text comes from, by chains of references within a scope.

    A reference names a place (``at``), and the references of all records there lead on. Records without one are
    ``own``, 0 hops from their place; others have a row ``ported`` for each end, a place with a text of its own,
    with the fewest hops to it, one ``cycle`` without a root where a way comes back to itself, and one ``missing``
    where a place has no record. Records with a null scope or place are left out. Groups are the references of a
    scope and the places named.
    """

    def run(_: tuple, b: pd.DataFrame) -> pd.DataFrame:
        to: dict[str, set] = {}
        own, out, refs = set(), [], []
        for k, a, f in b[["k", "a", "f"]].itertuples(index=False):
            if isinstance(f, str):
                to.setdefault(a, set()).add(f)
                refs.append((int(k), f))
            else:
                own.add(a)
        known: dict[str, tuple] = {}
        for k, f in refs:
            if f not in known:
                hops, level = {f: 1}, [f]
                while level:
                    ahead = []
                    for x in level:
                        for y in to.get(x, ()):
                            if y not in hops:
                                hops[y] = hops[x] + 1
                                ahead.append(y)
                    level = ahead
                # What is left after taking away all that only leads to ends holds a cycle.
                left = set(hops)
                while done := {x for x in left if left.isdisjoint(to.get(x, ()))}:
                    left -= done
                known[f] = [(x, h) for x, h in hops.items() if x in own], bool(left), any(x not in own and x not in to for x in hops)
            ends, cycle, missing = known[f]
            out += [(k, x, h, "ported") for x, h in ends] + [(k, None, None, "cycle")] * cycle + [(k, None, None, "missing")] * missing
        return pd.DataFrame(out, columns=["k", "r", "h", "s"]).astype({"h": "Int64"})

    r = df.select(F.col(key).alias("k"), F.col(scope).alias("g"), F.col(at).alias("a"), F.col(source).alias("f")).where("g is not null and a is not null")
    refs, plain = r.where("f is not null"), r.where("f is null")
    texts = plain.select("g", "a").join(refs.select("g", F.col("f").alias("a")).distinct(), ["g", "a"], "left_semi").distinct()
    use = refs.unionByName(texts, allowMissingColumns=True)
    chains = use.groupBy("g").applyInPandas(run, "k long, r string, h long, s string")
    own = plain.select("k", F.col("a").alias("r"), F.lit(0).cast("long").alias("h"), F.lit("own").alias("s"))
    return own.unionByName(chains).select(F.col("k").alias(key), F.col("r").alias("root"), F.col("h").alias("hops"), F.col("s").alias("state"))
