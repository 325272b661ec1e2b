"""Positions of a plane's flags: gaps, runs, and the exact sizes of the encodings of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.planes import bytes_of

#: Sizes of headers in bytes: gap list, Elias-Fano, run lengths.
GAP_HEAD, EF_HEAD, RLE_HEAD = 4, 17, 5


def flags(blobs: DataFrame, bit: int, *keys: str) -> DataFrame:
    """keys, n (bytes of the blob), pos: the positions whose byte has the bit."""
    keys = keys or ("source_id",)
    each = bytes_of(blobs.withColumn("n", F.octet_length("data").cast("long")), *keys, "n")
    return each.where(F.expr(f"(v >> {bit}) & 1 = 1")).select(*keys, "n", "pos")


def gaps(pos: DataFrame, *keys: str) -> DataFrame:
    """flags() with gap: the distance from the flag before; the first one's is its position."""
    keys = keys or ("source_id",)
    return pos.withColumn("gap", F.col("pos") - F.lag("pos", 1, 0).over(Window.partitionBy(*keys).orderBy("pos")))


def from_gaps(gap: DataFrame, *keys: str) -> DataFrame:
    """keys, nth, pos: positions again, as the running sum of gaps."""
    keys = keys or ("source_id",)
    w = Window.partitionBy(*keys).orderBy("pos")
    nth = gap.select(*keys, F.row_number().over(w).alias("nth"), "gap")
    return nth.select(*keys, "nth", F.sum("gap").over(Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)).alias("pos"))


def gap_stats(gap: DataFrame, *keys: str) -> DataFrame:
    """keys, k, gap_min, gap_max, gap_mean, gap_stddev, gap_cv, gap_uniformity, leading_gap_pct (share of gaps of 1)."""
    keys = keys or ("source_id",)
    df = gap.groupBy(*keys).agg(F.count("*").alias("k"), F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.avg("gap").alias("gap_mean"), F.stddev_pop("gap").alias("gap_stddev"), F.avg((F.col("gap") == 1).cast("int")).alias("one"))
    cv = F.coalesce(F.try_divide("gap_stddev", "gap_mean"), F.lit(0.0))
    return df.select(*keys, "k", "gap_min", "gap_max", "gap_mean", "gap_stddev", cv.alias("gap_cv"), (1 - cv / (1 + cv)).alias("gap_uniformity"), F.col("one").alias("leading_gap_pct"))


def gap_entropy(gap: DataFrame, *keys: str) -> DataFrame:
    """keys, spatial_entropy: Shannon entropy of the gaps."""
    keys = keys or ("source_id",)
    n = gap.groupBy(*keys, "gap").agg(F.count("*").alias("c"))
    s = n.groupBy(*keys).agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"))
    return s.select(*keys, (F.log2(F.col("k").cast("double")) - F.col("s") / F.col("k")).alias("spatial_entropy"))


def runs(pos: DataFrame, *keys: str) -> DataFrame:
    """keys, n, flagged, start, length: maximal runs of flagged and of clear bytes, by gaps and islands.

    A set run's clear neighbour on the left and, for the last one, on the right come with it, so one window does.
    Blobs without any flag have no row here.
    """
    keys = keys or ("source_id",)
    by = Window.partitionBy(*keys).orderBy("pos")
    island = pos.withColumn("g", F.col("pos") - F.row_number().over(by))
    sets = island.groupBy(*keys, "n", "g").agg(F.min("pos").alias("start"), F.count("*").alias("length"))
    order = Window.partitionBy(*keys).orderBy("start")
    ends = sets.withColumns({"before": F.lag(F.col("start") + F.col("length"), 1, 0).over(order), "last": F.lead("start").over(order).isNull()})
    end = F.col("start") + F.col("length")
    run = lambda flagged, start, length: F.struct(F.lit(flagged).alias("flagged"), start.alias("start"), length.alias("length"))
    each = F.array(run(False, F.col("before"), F.col("start") - F.col("before")), run(True, F.col("start"), F.col("length")), run(False, end, F.when(F.col("last"), F.col("n") - end).otherwise(F.lit(0).cast("long"))))
    return ends.select(*keys, "n", F.explode(each).alias("r")).select(*keys, "n", "r.*").where("length > 0")


def run_stats(run: DataFrame, *keys: str) -> DataFrame:
    """keys, n_runs, run_set_max, run_set_mean, run_clear_max, run_clear_mean (0 where there are none)."""
    keys = keys or ("source_id",)
    of = lambda f, flagged: F.coalesce(f(F.when(F.col("flagged") == flagged, F.col("length"))), F.lit(0))
    return run.groupBy(*keys).agg(F.count("*").alias("n_runs"), of(F.max, True).alias("run_set_max"), of(F.avg, True).alias("run_set_mean"), of(F.max, False).alias("run_clear_max"), of(F.avg, False).alias("run_clear_mean"))


def log2_floor(c: Column) -> Column:
    """Exact, as the number of binary digits less one."""
    return F.length(F.bin(c)) - 1


def bitset_size(n: Column) -> Column:
    return F.ceil(n / 8)


def gap_size(k: Column, largest: Column) -> Column:
    return GAP_HEAD + k * F.when(largest <= 255, 1).when(largest <= 65534, 2).otherwise(4)


def ef_low_bits(n: Column, k: Column) -> Column:
    """Low bits of Elias-Fano: whole binary logarithm of n / k, 0 to 30."""
    return F.when(n >= k, F.least(F.lit(30), log2_floor(F.floor(n / k)))).otherwise(0)


def sizes(pos: DataFrame, *keys: str) -> DataFrame:
    """keys, n, k, bitset, gap, ef, rle: exact bytes of each encoding of a plane with at least one flag; and the
    theoretical bits ef_bits and rle_bits."""
    keys = keys or ("source_id",)
    g = gaps(pos, *keys).groupBy(*keys).agg(F.max("n").alias("n"), F.count("*").alias("k"), F.max("gap").alias("largest"), F.max("pos").alias("last"))
    r = runs(pos, *keys).groupBy(*keys).agg(F.sum(2 * log2_floor(F.col("length")) + 1).cast("long").alias("gamma"))
    df = g.withColumn("l", ef_low_bits(F.col("n"), F.col("k"))).join(r, list(keys))
    ef = EF_HEAD + F.ceil(F.col("k") * F.col("l") / 8) + F.ceil((F.col("k") + F.expr("last >> l")) / 8)
    return df.select(*keys, "n", "k", bitset_size(F.col("n")).alias("bitset"), gap_size(F.col("k"), F.col("largest")).cast("long").alias("gap"), ef.cast("long").alias("ef"), (RLE_HEAD + F.ceil(F.col("gamma") / 8)).cast("long").alias("rle"), (F.col("k") * F.col("l") + F.expr("n >> l") + F.col("k")).cast("long").alias("ef_bits"), (8 + F.col("gamma")).alias("rle_bits"))


def profile(blobs: DataFrame, bit: int, compressed: DataFrame) -> DataFrame:
    """The profile of each blob's plane: gaps, runs, sizes and the best of four codings (ties to the first of bitset,
    delta, bitset and gzip, delta and gzip). A blob without flags has no gaps and runs; `compressed` has gzip sizes."""
    pos = flags(blobs, bit)
    gap = gaps(pos)
    base = blobs.where(F.octet_length("data") > 0).select("source_id", F.octet_length("data").cast("long").alias("n"))
    df = base
    for part in (gap_stats(gap), gap_entropy(gap), run_stats(runs(pos)), sizes(pos).select("source_id", F.col("gap").alias("_gap"))):
        df = df.join(part, "source_id", "left")
    df = df.join(compressed, "source_id").withColumn("k", F.coalesce("k", F.lit(0)))
    df = df.withColumns({"density": F.col("k") / F.col("n"), "enc_bitset": bitset_size(F.col("n")).cast("long"), "enc_delta_raw": F.coalesce("_gap", F.lit(GAP_HEAD)).cast("long")}).drop("_gap")
    codings = ("enc_bitset", "enc_delta_raw", "enc_bitset_gz", "enc_delta_gz")
    best = F.array_min(F.array(*(F.struct(F.col(c).alias("b"), F.lit(i).alias("i"), F.lit(c.removeprefix("enc_")).alias("m")) for i, c in enumerate(codings))))
    df = df.withColumn("_best", best)
    return df.select("*", F.col("_best.b").alias("enc_best"), F.col("_best.m").alias("enc_best_method"), (100 * (F.col("_best.b") / F.col("n") - 1)).alias("enc_vs_raw_pct")).drop("_best")
