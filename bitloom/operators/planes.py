"""Bit planes of blobs or chunks. One histogram of byte values for each key answers most questions about them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

FULL = 255
#: Bytes that are counted at a time, so that memory doesn't grow with a blob.
STEP = 1 << 20
#: Bytes of many small blobs whose places in the table are worked out at a time, so that they stay in the cache.
NEAR = 1 << 17


def byte_at(data: Column, pos: Column) -> Column:
    """The byte at `pos` (from 0) as a whole number."""
    return F.ascii(F.decode(F.substring(data, pos + 1, F.lit(1)), "ISO-8859-1"))


def bytes_of(blobs: DataFrame, *keys: str) -> DataFrame:
    """keys, pos (from 0), v: a row for each byte. Aggregate in the same stage; never shuffle these rows."""
    keys = keys or ("source_id",)
    df = blobs.where(F.octet_length("data") > 0)
    df = df.select(*keys, "data", F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1)).alias("pos"))
    return df.select(*keys, F.col("pos").cast("long").alias("pos"), byte_at(F.col("data"), F.col("pos")).alias("v"))


def spans(sizes: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of rows, from and to, of about `step` bytes each; a larger row is alone."""
    ends, s = np.cumsum(sizes), 0
    while s < len(sizes):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + step, side="right")))
        yield s, e
        s = e


def counted(blobs: list[np.ndarray]) -> np.ndarray:
    """A row of 256 counts for each blob."""
    if len(blobs) == 1:
        return sum((np.bincount(blobs[0][i : i + STEP], minlength=256) for i in range(0, len(blobs[0]), STEP)), np.zeros(256, np.int64))[None]
    sizes, table = np.array([len(b) for b in blobs]), np.empty((len(blobs), 256), np.int64)
    for s, e in spans(sizes, NEAR):
        row = np.repeat(np.arange(e - s) * 256, sizes[s:e])
        table[s:e] = np.bincount(row + np.concatenate(blobs[s:e]), minlength=256 * (e - s)).reshape(-1, 256)
    return table


def histogram(blobs: DataFrame, *keys: str) -> DataFrame:
    """keys, v, n: how often each byte value stands in each blob. Bytes are counted in Arrow batches; only the counts are
    rows. Null and empty blobs have none; rows of equal keys count together."""
    keys = keys or ("source_id",)
    df = blobs.where(F.octet_length("data") > 0).select(*keys, "data")
    schema = StructType([*df.schema.fields[:-1]]).add("v", IntegerType()).add("n", LongType())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data = [np.frombuffer(x, np.uint8) for x in batch.column(len(keys)).to_pylist()]
            for s, e in spans(np.array([len(x) for x in data], np.int64)):
                table = counted(data[s:e])
                row, v = np.nonzero(table)
                own = [c.take(pa.array(row + s)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(v.astype(np.int32)), pa.array(table[row, v].astype(np.int64))], names=[*keys, "v", "n"])

    return df.mapInArrow(run, schema).groupBy(*keys, "v").agg(F.sum("n").alias("n"))


def flag(v: Column, bit) -> Column:
    return F.shiftright(v, bit).bitwiseAND(1) if isinstance(bit, int) else F.expr(f"(v >> {bit}) & 1")


def clear(v: Column, bit: int) -> Column:
    return v.bitwiseAND(FULL ^ (1 << bit))


def remap(v: Column, bit: int) -> Column:
    """Squeeze out bit slot `bit`: higher bits move down by one."""
    return F.shiftleft(F.shiftright(v, bit + 1), bit).bitwiseOR(v.bitwiseAND((1 << bit) - 1))


def unremap(v: Column, bit: int) -> Column:
    return F.shiftleft(F.shiftright(v, bit), bit + 1).bitwiseOR(v.bitwiseAND((1 << bit) - 1))


def reconstruct(aligned: Column, flagged: Column, bit: int) -> Column:
    return aligned.bitwiseOR(F.shiftleft(flagged, bit))


def popcounts(hist: DataFrame, *keys: str) -> DataFrame:
    """keys, bit, flags, n: flagged bytes of the eight planes, and all bytes."""
    keys = keys or ("source_id",)
    planes = [F.sum(F.when(F.shiftright("v", b).bitwiseAND(1) == 1, F.col("n")).otherwise(0)).alias(f"p{b}") for b in range(8)]
    wide = hist.groupBy(*keys).agg(F.sum("n").alias("n"), *planes)
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.col(f"p{b}").alias("flags")) for b in range(8))))
    return wide.select(*keys, each.alias("e"), "n").select(*keys, "e.bit", "e.flags", "n")


def ranked(planes: DataFrame, *keys: str) -> DataFrame:
    """popcounts with depth (order of flags, then bit), rank_bit (the bit's place among those left at its depth), and
    density. This is the whole recursive sweep: squeezing a slot out keeps the other planes and their order."""
    keys = keys or ("source_id",)
    by_bit = F.sort_array(F.collect_list(F.struct("flags", "bit")).over(Window.partitionBy(*keys)))
    depth = (F.row_number().over(Window.partitionBy(*keys).orderBy("flags", "bit")) - 1).alias("depth")
    df = planes.select(*keys, "bit", "flags", "n", depth, by_bit.alias("_all"))
    gone = F.size(F.filter(F.slice("_all", F.lit(1), F.col("depth")), lambda p: p["bit"] < F.col("bit")))
    return df.select(*keys, "depth", "bit", (F.col("bit") - gone).alias("rank_bit"), "flags", "n", (F.col("flags") / F.col("n")).alias("density"))


def sweep_winner(planes: DataFrame, *keys: str) -> DataFrame:
    """keys, bit, flags: the sparsest plane, of equals the lowest."""
    keys = keys or ("source_id",)
    return planes.groupBy(*keys).agg(F.min(F.struct("flags", "bit")).alias("m")).select(*keys, "m.bit", "m.flags")


def levels(rank: DataFrame, *keys: str, plain: bool = False) -> DataFrame:
    """The levels that the encoder makes: it stops where what is left is all zero, or all one.

    Recursive mode tests before a level on squeezed bytes (the lowest plane left is what makes a one), the mode without
    squeezing after a level on the bytes themselves (only bit 0 can make a one).
    """
    keys = keys or ("source_id",)
    rest = Window.partitionBy(*keys).orderBy("depth").rowsBetween(1 if plain else 0, Window.unboundedFollowing)
    left, low = F.coalesce(F.sum("flags").over(rest), F.lit(0)), F.min(F.struct("bit", "flags")).over(rest)
    one = (left == F.col("n")) & (low["flags"] == F.col("n")) & ((low["bit"] == 0) if plain else F.lit(True))
    stop = (left == 0) | F.coalesce(one, F.lit(False))
    seen = Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1 if plain else 0)
    df = rank.withColumn("_stop", stop.cast("int"))
    df = df.withColumn("_over", F.coalesce(F.max("_stop").over(seen), F.lit(0)))
    return df.where("_over = 0").drop("_stop", "_over")


def uniformity(hist: DataFrame, *keys: str) -> DataFrame:
    """keys, distinct_bytes, all_zero, all_one, all_same."""
    keys = keys or ("source_id",)
    return hist.groupBy(*keys).agg(F.count("*").alias("distinct_bytes"), F.bool_and(F.col("v") == 0).alias("all_zero"), F.bool_and(F.col("v") == 1).alias("all_one"), (F.min("v") == F.max("v")).alias("all_same"))


def bitset(blobs: DataFrame, bit: int, *keys: str) -> DataFrame:
    """keys, bits (binary): the plane packed eight positions to a byte, the first lowest."""
    keys = keys or ("source_id",)
    words = bytes_of(blobs, *keys).groupBy(*keys, F.expr("pos div 8").alias("at")).agg(F.sum(F.expr(f"((v >> {bit}) & 1) << cast(pos % 8 as int)")).alias("b"))
    packed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "b"))), lambda x: F.lpad(F.hex(x["b"]), 2, "0")), "")
    return words.groupBy(*keys).agg(F.unhex(packed).alias("bits"))


def unpacked(bitsets: DataFrame, *keys: str) -> DataFrame:
    """keys, pos of each set bit of `bits`."""
    keys = keys or ("source_id",)
    each = bytes_of(bitsets.withColumnRenamed("bits", "data"), *keys)
    return each.select(*keys, "pos", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b")).where("(v >> b) & 1 = 1").select(*keys, (F.col("pos") * 8 + F.col("b")).alias("pos"))
