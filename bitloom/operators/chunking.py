"""Splitting blobs into ordered chunks: source_id, index, offset, size, data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _split(blobs: DataFrame, size: Column) -> DataFrame:
    """Chunks of `size` bytes, the last one shorter; an empty blob has none. Only chunk numbers are exploded."""
    df = blobs.where(F.octet_length("data") > 0).withColumn("_size", size.cast("long")).withColumn("_n", F.octet_length("data").cast("long"))
    df = df.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_n - 1) div _size"))))
    offset = F.col("index") * F.col("_size")
    return df.select("source_id", "index", offset.alias("offset"), F.least("_size", F.col("_n") - offset).alias("size"), F.substring("data", (offset + 1).cast("int"), F.col("_size").cast("int")).alias("data"))


def fixed(blobs: DataFrame, chunk_size: int) -> DataFrame:
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    return _split(blobs, F.lit(chunk_size))


def frames(blobs: DataFrame, frame_size: int = 0, width: int = 0, height: int = 0, channels: int = 3) -> DataFrame:
    """Video frames; width, height and channels overrule frame_size, what remains is the last chunk."""
    size = width * height * channels if width and height else frame_size
    if size <= 0:
        raise ValueError("a frame needs a positive size")
    return _split(blobs, F.lit(size))


def adaptive_size(length: Column, target: int = 16) -> Column:
    """Chunk size for about `target` chunks, between 512 bytes and 1 MiB."""
    return F.greatest(F.lit(512), F.least(F.lit(1 << 20), F.floor(length / max(1, target)).cast("long")))


def adaptive(blobs: DataFrame, target: int = 16) -> DataFrame:
    return _split(blobs, adaptive_size(F.octet_length("data"), target))


def chunked(blobs: DataFrame, chunk_size: int = 0, frame_size: int = 0, width: int = 0, height: int = 0, channels: int = 3, target: int = 16) -> DataFrame:
    """Frames by width and height, else by frame size, else fixed chunks, else adaptive ones."""
    if (width and height) or frame_size:
        return frames(blobs, frame_size, width, height, channels)
    return fixed(blobs, chunk_size) if chunk_size else adaptive(blobs, target)


def boundaries(transitions: DataFrame, min_size: int = 256) -> DataFrame:
    """source_id, offset, nth: offsets at which homogeneous regions begin.

    Of the distinct transition offsets of a source, each is kept that lies min_size bytes or more past the last kept
    one (the start counts as kept). The choice depends on the choices before, so it is a fold over the sorted array.
    """
    found = transitions.groupBy("source_id").agg(F.sort_array(F.collect_set("byte_offset")).alias("at"))
    kept = F.aggregate("at", F.array(F.lit(0).cast("long")), lambda a, x: F.when(x - F.element_at(a, -1) >= min_size, F.concat(a, F.array(x))).otherwise(a))
    return found.select("source_id", F.posexplode(kept).alias("nth", "offset")).select("source_id", "nth", "offset")


def regions(bounds: DataFrame, sizes: DataFrame) -> DataFrame:
    """source_id, nth, offset, size of the regions between boundaries; sizes: source_id, size."""
    order = Window.partitionBy("source_id").orderBy("offset")
    return bounds.join(sizes, "source_id").select("source_id", "nth", "offset", (F.coalesce(F.lead("offset").over(order), F.col("size")) - F.col("offset")).alias("size"))
