"""Citations: forms, sort keys, and resolution with explicit ambiguity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of a place within a work.
FORMS = {
    "page_column": r"^(\d+)([a-e])(?:\.?(\d+))?$",
    "book_number": r"^(\d+)\.(\d+)(?:\.(\d+))?$",
    "fragment": r"^([AB])\s?(\d+)(?:\.(\d+))?$",
    "number": r"^(\d+)$",
}


def scheme(c: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(c.rlike(kv[1]), F.lit(kv[0])), FORMS.items(), F.when(F.lit(False), F.lit(None)))


def sort_key(c: Column) -> Column:
    """Struct (series, a, b, n) that orders citations of one scheme; numbers compare as numbers."""

    def part(form: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(c, FORMS[form], k), F.lit(""))

    s = scheme(c)
    a = F.when(s == "page_column", part("page_column", 1)).when(s == "book_number", part("book_number", 1)).when(s == "fragment", part("fragment", 2)).when(s == "number", part("number", 1))
    b = F.when(s == "page_column", part("page_column", 2)).when(s == "book_number", F.lpad(part("book_number", 2), 9, "0")).otherwise("")
    n = F.when(s == "page_column", part("page_column", 3)).when(s == "book_number", part("book_number", 3)).when(s == "fragment", part("fragment", 3))
    series = F.when(s == "fragment", part("fragment", 1)).otherwise("")
    return F.struct(series.alias("series"), F.try_to_number(a, F.lit("999999999")).cast("long").alias("a"), F.coalesce(b, F.lit("")).alias("b"), F.coalesce(F.try_to_number(n, F.lit("999999999")).cast("long"), F.lit(0)).alias("n"))


def resolve(queries: DataFrame, places: DataFrame) -> DataFrame:
    """(query, stage, candidates, ambiguous): works that hold a place, by the first stage that finds any.

    Stage 1: the work of the query's context. Stage 2: any work with the very place.
    Stage 3: any work with the page or number alone. A query that one stage answers goes
    no further, and places come as distinct (number, work). Candidates are all kept, sorted.
    """
    q = queries.select("query", "context", F.regexp_extract("query", r"^(\d+)", 1).alias("num"))
    p = places.select("work_id", "citation", F.regexp_extract("citation", r"^(\d+)", 1).alias("pnum")).distinct()
    exact = q.join(p, q["query"] == p["citation"]).select("query", F.when(F.col("work_id") == F.col("context"), 1).otherwise(2).alias("stage"), "work_id")
    open_ = q.where("num <> ''").join(exact.select("query").distinct(), "query", "left_anti")
    loose = open_.join(p.select("pnum", "work_id").distinct(), F.col("num") == F.col("pnum")).select("query", F.lit(3).alias("stage"), "work_id")
    by = exact.unionByName(loose).groupBy("query", "stage").agg(F.array_sort(F.collect_set("work_id")).alias("candidates"))
    best = by.groupBy("query").agg(F.min_by("candidates", "stage").alias("candidates"), F.min("stage").alias("stage"))
    return best.select("query", "stage", F.array_join("candidates", ",").alias("candidates"), (F.size("candidates") > 1).alias("ambiguous"))
