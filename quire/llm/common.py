"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, stamp: str, columns: list[str]) -> DataFrame:
    """One row for each key: that with the latest stamp. Rows without a key are passed over.

    Only ``columns`` are kept, so that other columns cannot clash with later names.
    The aggregate leaves the rows partitioned by ``key``.
    """
    rest = [c for c in columns if c != key]
    if not rest:
        return df.select(key).where(F.col(key).isNotNull()).distinct()
    body = F.struct(*[F.col(c) for c in rest])
    when = F.struct(F.col(stamp).isNotNull(), F.col(stamp), F.xxhash64(*[F.col(c).cast("string") for c in rest]))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(body, when).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in rest])
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; without one, a folder of our own where everything runs on one machine."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if conf is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        conf = "file://" + os.path.join(tempfile.gettempdir(), "quire-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder; lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows evened out before Python work where the input has fewer splits than there are cores; else the splits stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches as frames of a few rows each, so that a worker's memory does not follow the size of its partition."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows).to_pandas()


@lru_cache
def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def record(df: pd.DataFrame, schema: str) -> pa.RecordBatch:
    """A frame as a batch of the columns that the schema names."""
    return pa.RecordBatch.from_pandas(df, schema=_arrow(schema), preserve_index=False)


class TooLarge(RuntimeError):
    """What was to be sent to every task is larger than its proven bound."""


def bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that is small by construction; fail loudly if it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"{what}: more than {limit} rows")
    return rows
