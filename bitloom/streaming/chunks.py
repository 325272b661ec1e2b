"""Chunk statistics of a stream of blobs: stateless, and the transitions between chunks with a state per source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitloom.operators import chunking


def blob_stream(spark: SparkSession, path: str, key: str, text: str, schema: str) -> DataFrame:
    """source_id, data of a text column of Parquet files as they arrive."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.select(F.col(key).cast("string").alias("source_id"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("data"))


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).load(path)
    return df.select(F.col("path").alias("source_id"), F.col("content").alias("data"))


def chunk_stats(blobs: DataFrame, chunk_size: int = 4096) -> DataFrame:
    """source_id, index, offset, size, p0 to p7: flags of each plane of each chunk, a projection without state."""
    chunks = chunking.fixed(blobs, chunk_size)
    bits = F.expr("transform(sequence(1, length(data)), i -> CAST(conv(hex(substring(data, i, 1)), 16, 10) AS INT))")
    df = chunks.select("source_id", "index", "offset", "size", bits.alias("v"))
    planes = [F.size(F.expr(f"filter(v, x -> (x >> {b}) & 1 = 1)")).alias(f"p{b}") for b in range(8)]
    return df.select("source_id", "index", "offset", "size", *planes)


def target_changes(stats: DataFrame) -> DataFrame:
    """source_id, index, before, after: chunks whose sparsest plane differs from that of the chunk before, across
    micro-batches; the state of a source is its last chunk's plane."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("index").itertuples():
            bit = min(range(8), key=lambda b: (getattr(row, f"p{b}"), b))
            if last is not None and bit != last:
                out.append((key[0], row.index, last, bit))
            last = bit
        state.update((last,))
        yield pd.DataFrame(out, columns=["source_id", "index", "before", "after"])

    return stats.groupBy("source_id").applyInPandasWithState(run, "source_id string, index long, before int, after int", "bit int", "append", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, path: str) -> DataFrame:
    """Run a stream over what there is into Parquet at `path`, and read that."""
    df.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
