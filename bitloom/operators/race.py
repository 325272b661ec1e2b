"""Choosing among encodings by their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order in which encodings of equal size win.
PRIORITY = ("HUFFMAN", "LZ77HUFF", "RLE", "BITSET", "GAP", "EF", "LZ77")
#: Bytes of a level's header.
LEVEL_HEAD = 11


def candidates(density: Column) -> Column:
    """Encodings worth trying at a density: four always, gap lists and Elias-Fano to 0.30, LZ77 from 0.15 to 0.85."""
    sparse, middle = density <= 0.30, (density >= 0.15) & (density <= 0.85)
    return F.array_compact(F.array(F.lit("HUFFMAN"), F.lit("LZ77HUFF"), F.lit("RLE"), F.lit("BITSET"), F.when(sparse, F.lit("GAP")), F.when(sparse, F.lit("EF")), F.when(middle, F.lit("LZ77"))))


def winner(sizes: DataFrame, *keys: str) -> DataFrame:
    """keys, fmt, bytes: the smallest of the closed-form encodings allowed at the density, ties by PRIORITY."""
    keys = keys or ("source_id",)
    known = ("RLE", "BITSET", "GAP", "EF")
    each = F.array(*(F.struct(F.col(f.lower()).alias("bytes"), F.lit(PRIORITY.index(f)).alias("priority"), F.lit(f).alias("fmt")) for f in known))
    df = sizes.withColumn("c", candidates(F.col("k") / F.col("n"))).select(*keys, F.array_min(F.filter(each, lambda e: F.array_contains(F.col("c"), e["fmt"]))).alias("m"))
    return df.select(*keys, "m.fmt", "m.bytes")


def cutoff(levels: Column, terminal: Column) -> Column:
    """struct(cost, depth): the cheapest depth to stop at, from levels array<struct<flag_bytes, ans_bytes>>.

    From the deepest level up: a level costs its header, its flags and the cheaper of what lies below it and its own
    aligned bytes. A stop is compared with a header of its own and charged without it.
    """
    zero = F.struct(terminal.cast("long").alias("cost"), F.size(levels).alias("depth"), (F.size(levels) - 1).alias("at"))

    def step(s: Column, x: Column) -> Column:
        stop = LEVEL_HEAD + x["ans_bytes"] < s["cost"]
        below = F.when(stop, x["ans_bytes"]).otherwise(s["cost"])
        return F.struct((LEVEL_HEAD + x["flag_bytes"] + below).cast("long").alias("cost"), F.when(stop, s["at"]).otherwise(s["depth"]).alias("depth"), (s["at"] - 1).alias("at"))

    return F.aggregate(F.reverse(levels), zero, step, lambda s: F.struct(s["cost"].alias("cost"), s["depth"].alias("depth")))
