"""Byte blobs as DataFrames: source_id string, data binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The UTF-8 bytes of a text column; a null text is an empty blob."""
    return df.select(F.col(key).cast("string").alias("source_id"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("data"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """Texts; `even`: spread over the cores."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return texts(spread(df) if even else df, "doc_id", "text")


def spread(df: DataFrame) -> DataFrame:
    """The same rows. A file is split by its row groups at most: where the largest split has more than three times its
    share of the rows for all cores, rows are dealt over four splits a core by the hash of all their columns. Counting the
    rows of splits reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.groupBy(F.spark_partition_id().alias("split")).count().agg(F.max("count"), F.sum("count")).first()
    return df.repartition(4 * cores, *df.columns) if rows[1] and rows[0] * cores > 3 * rows[1] else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages"), "page_id", "html")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "benchmark"), "item_id", "text")


def files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Whole files; a directory gives its own files, by default without those of folders below it. Spark's reader
    passes over files of no bytes, which have no chunks either."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select(F.col("path").alias("source_id"), F.col("content").alias("data"))


def inventory(blobs: DataFrame) -> DataFrame:
    """source_id, size, sha256 of each blob."""
    return blobs.select("source_id", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha256"))


def uint_be(data: Column, start: int, width: int) -> Column:
    """Big-endian unsigned whole number of `width` (at most 7) bytes from byte `start` (from 0)."""
    return F.conv(F.hex(F.substring(data, start + 1, width)), 16, 10).cast("long")


def write_blobs(blobs: DataFrame, path: str) -> None:
    blobs.write.mode("overwrite").parquet(path)
