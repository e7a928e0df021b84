"""Readers and writers of the engine's inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may be absent: then empty, with the schema."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def json_records(spark: SparkSession, path: str, key: list[str], value: str, prefix: str | None = None, lines: bool = False) -> DataFrame:
    """(key, value) of JSON records (``lines``: one to a line, of any number), or of one object that maps keys to values; duplicate keys raise an error."""
    raw = spark.read.json(path, multiLine=not lines)
    if set(key) <= set(raw.columns):
        out = raw.select(F.concat_ws(".", *[F.col(k).cast("string") for k in key]).alias("key"), F.col(value).cast("string").alias("value"))
    else:
        out = raw.select(F.explode(F.create_map(*[x for c in raw.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])).alias("key", "value"))
    if prefix:
        out = out.where(F.col("key").startswith(prefix))
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col("key")))).otherwise(F.col("value"))
    return out.select("key", checked.alias("value"))


def analyses_lines(spark: SparkSession, path: str, needed: DataFrame) -> DataFrame:
    """(form, lemma, gloss, parse) of a tab-separated lexicon with repeated {id flag form,lemma<tab>gloss<tab>parse} groups, for the needed forms alone."""
    lines = spark.read.text(path).select(F.split("value", "\t", 2).alias("p")).select(F.col("p")[0].alias("form"), F.get("p", F.lit(1)).alias("rest"))
    group = r"\{(\d+) (\d+) ([^,\t]*),?([^\t]*)\t([^\t]*)\t([^}]*)\}"
    parts = F.arrays_zip(*[F.regexp_extract_all("rest", F.lit(group), F.lit(k)).alias(n) for k, n in ((4, "lemma"), (5, "gloss"), (6, "parse"))])
    return lines.join(needed.select("form").distinct(), "form", "left_semi").select("form", F.posexplode(parts).alias("ord", "g")).select("form", "ord", "g.*")


def marked_text(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """(file, line_no, section, text): plain text whose marker lines begin sections."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))
    from quire.operators.sequence import sessions

    return sessions(t, ["file"], ["line_no"], F.col("text").rlike(marker))


def xml_rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).load(path)


def release_index(spark: SparkSession, path: str, derived: str) -> DataFrame:
    """(path, sha256, size) of the files below a folder, derived ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).where(~F.col("path").rlike(derived))


def write_sharded(df: DataFrame, path: str, shard: Column, key: str) -> None:
    """Partitioned by shard and sorted by key within, so that the content decides the order."""
    df.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str, key: str) -> None:
    """One JSON object to a line, nulls kept, in ranges and order of ``key``, so that the content decides the bytes of each range."""
    df.repartitionByRange(key).sortWithinPartitions(*df.columns).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted as need be, line ends of two bytes, and a byte-order mark before the header of each file."""
    marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    marked.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)
