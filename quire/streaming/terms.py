"""Structured Streaming over files: the batch plans' term counts, kept up as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.index import postings


def documents(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def term_counts(stream: DataFrame) -> DataFrame:
    """(term, n) so far; write with outputMode update or complete."""
    return postings(stream, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, stamp: str, key: str, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """(start, key, n) per tumbling window; rows later than the watermark are dropped, as the state is bounded by it."""
    t = stream.withColumn("_t", F.col(stamp).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
