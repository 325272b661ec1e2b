"""Byte and pair statistics: entropies, stride choice, context tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from bitloom.operators.planes import STEP, byte_at, bytes_of

#: Strides tried, bytes looked at, gain in bits that a stride over 1 needs, and the frequencies' sum.
STRIDES = (1, 2, 3, 4, 6, 8, 12, 16)
SAMPLE_BYTES = 1_000_000
STRIDE_GAIN = 0.05
TOTAL = 16_384
MIN_CONTEXT = 32
#: Entropy given where a stream is no longer than the stride.
NO_CONTEXT = 8.0


def order0(hist: DataFrame, *keys: str) -> DataFrame:
    """keys, n, h: Shannon entropy of the byte values, in bits."""
    keys = keys or ("source_id",)
    sums = hist.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return sums.select(*keys, "n", (F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n")).alias("h"))


def followers(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (256 * context + byte, ascending) stand k places apart in x, and how often."""
    if len(x) <= 4 * 65_536:
        return np.unique(x[:-k].astype(np.int32) << 8 | x[k:], return_counts=True)
    total = np.zeros(65_536, np.int64)
    for i in range(0, len(x) - k, STEP):
        y = x[i : i + STEP + k]
        total += np.bincount(y[:-k].astype(np.int32) << 8 | y[k:], minlength=65_536)
    which = np.flatnonzero(total)
    return which, total[which]


def pairs(blobs: DataFrame, strides: tuple[int, ...] = (1,), *keys: str, sample: int | None = None) -> DataFrame:
    """keys, k, ctx, sym, n: how often byte `sym` follows `ctx` k places before, in the whole blob or in its first
    `sample` bytes. Pairs are counted in Arrow batches; only the counts are rows."""
    keys = keys or ("source_id",)
    df = blobs.where(F.octet_length("data") > min(strides)).select(*keys, (F.col("data") if sample is None else F.substring("data", 1, sample)).alias("data"))
    schema = StructType([*df.schema.fields[:-1]]).add("k", IntegerType()).add("ctx", IntegerType()).add("sym", IntegerType()).add("n", LongType())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, blob in enumerate(batch.column(len(keys)).to_pylist()):
                x = np.frombuffer(blob, np.uint8)
                for k in strides:
                    if len(x) > k:
                        which, n = followers(x, k)
                        own = [c.take(pa.array(np.full(len(n), i))) for c in batch.columns[:-1]]
                        parts = (np.full(len(n), k), which >> 8, which & 255)
                        yield pa.RecordBatch.from_arrays([*own, *(pa.array(p.astype(np.int32)) for p in parts), pa.array(n.astype(np.int64))], names=[*keys, "k", "ctx", "sym", "n"])

    return df.mapInArrow(run, schema).groupBy(*keys, "k", "ctx", "sym").agg(F.sum("n").alias("n"))


def by_stride(blobs: DataFrame, strides: tuple[int, ...] = STRIDES, *keys: str, sample: int | None = None) -> DataFrame:
    """keys, k, h: as conditional() of all pairs, in one pass and without a shuffle, for keys that tell the blobs apart.
    A blob no longer than a stride has NO_CONTEXT there; null blobs are empty."""
    keys = keys or ("source_id",)
    data = F.coalesce("data", F.lit(b""))
    df = blobs.select(*keys, (data if sample is None else F.substring(data, 1, sample)).alias("data"))
    schema = StructType([*df.schema.fields[:-1]]).add("k", IntegerType()).add("h", DoubleType())
    xlog = lambda n: float((n * np.log2(n)).sum())

    def entropy(x: np.ndarray, k: int) -> float:
        if len(x) <= k:
            return NO_CONTEXT
        which, n = followers(x, k)
        ctx = np.bincount(which >> 8, weights=n)
        return (xlog(ctx[ctx > 0]) - xlog(n)) / (len(x) - k)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h = [entropy(np.frombuffer(b, np.uint8), k) for b in batch.column(len(keys)).to_pylist() for k in strides]
            own = [c.take(pa.array(np.repeat(np.arange(batch.num_rows), len(strides)))) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.tile(np.array(strides, np.int32), batch.num_rows)), pa.array(h, pa.float64())], names=[*keys, "k", "h"])

    return df.mapInArrow(run, schema)


def conditional(pair: DataFrame, *keys: str) -> DataFrame:
    """keys, k, h: entropy of a byte given the one k places before: sum over contexts of n log n less that over pairs."""
    keys = keys or ("source_id",)
    xlog = lambda c: c * F.log2(c.cast("double"))
    ctx = pair.groupBy(*keys, "k", "ctx").agg(F.sum("n").alias("n"), F.sum(xlog(F.col("n"))).alias("s"))
    return ctx.groupBy(*keys, "k").agg(((F.sum(xlog(F.col("n"))) - F.sum("s")) / F.sum("n")).alias("h"))


def stride(cond: DataFrame, *keys: str) -> DataFrame:
    """keys, k, h, h1: the stride of least entropy (rounded to 9 places, ties to the smallest), or 1 without a gain."""
    keys = keys or ("source_id",)
    best = cond.groupBy(*keys).agg(F.min(F.struct(F.round("h", 9).alias("h"), "k")).alias("m"), F.min(F.when(F.col("k") == 1, F.round("h", 9))).alias("h1"))
    gain = F.col("h1") - F.col("m.h") >= STRIDE_GAIN
    return best.select(*keys, F.when(gain, F.col("m.k")).otherwise(1).alias("k"), F.when(gain, F.col("m.h")).otherwise(F.col("h1")).alias("h"), "h1")


def supported(pair: DataFrame, least: int = MIN_CONTEXT, *keys: str) -> DataFrame:
    """keys, k, ctx, n, symbols of the contexts seen at least so often."""
    keys = keys or ("source_id",)
    return pair.groupBy(*keys, "k", "ctx").agg(F.sum("n").alias("n"), F.count("*").alias("symbols")).where(F.col("n") >= least)


def with_fallback(pair: DataFrame, hist: DataFrame, least: int = MIN_CONTEXT, *keys: str) -> DataFrame:
    """pair rows with `p`: the share of the symbol in its context's table, or in the whole blob's where the context is
    too rare for one: a left join and coalesce."""
    keys = keys or ("source_id",)
    by_ctx = supported(pair, least, *keys).select(*keys, "k", "ctx", F.col("n").alias("ctx_n"))
    whole = hist.select(*keys, F.col("v").alias("sym"), (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("p0"))
    df = pair.join(by_ctx, [*keys, "k", "ctx"], "left").join(whole, [*keys, "sym"])
    return df.select(*keys, "k", "ctx", "sym", "n", F.col("ctx_n").isNull().alias("fell_back"), F.coalesce(F.col("n") / F.col("ctx_n"), "p0").alias("p"))


def normalised(hist: DataFrame, *keys: str, total: int = TOTAL) -> DataFrame:
    """keys, v, n, f: frequencies of at least 1 that sum to `total`.

    Each is its rounded share. What is missing or over goes round in descending order of that frequency (then by v),
    one at a time: that is the whole rounds and one more for the first few, in closed form. A surplus is taken from
    those above 1 only, where the sequence of takings is a fold over at most 256 values.
    """
    keys = keys or ("source_id",)
    w = Window.partitionBy(*keys)
    df = hist.withColumn("f0", F.greatest(F.lit(1), F.bround(F.col("n") * total / F.sum("n").over(w)).cast("long")))
    df = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("f0")).alias("o"), "v", "n", "f0"))).alias("t"), (F.lit(total) - F.sum("f0")).alias("d"), F.count("*").alias("m"))
    add = F.transform("t", lambda x, i: F.struct(x["v"].alias("v"), x["n"].alias("n"), (x["f0"] + F.expr("d div m") + F.when(i < F.expr("d % m"), 1).otherwise(0)).alias("f")))
    take = F.expr("""aggregate(sequence(1, CAST(-d AS INT)), named_struct('f', transform(t, x -> x.f0), 'at', -1),
        (s, i) -> named_struct(
            'f', transform(s.f, (f, j) -> f - CAST(j = element_at(filter(transform(sequence(1, CAST(m AS INT)), o -> (s.at + o) % CAST(m AS INT)), c -> s.f[c] > 1), 1) AS BIGINT)),
            'at', element_at(filter(transform(sequence(1, CAST(m AS INT)), o -> (s.at + o) % CAST(m AS INT)), c -> s.f[c] > 1), 1)),
        s -> s.f)""")
    low = F.zip_with("t", take, lambda x, f: F.struct(x["v"].alias("v"), x["n"].alias("n"), f.cast("long").alias("f")))
    return df.select(*keys, F.explode(F.when(F.col("d") >= 0, add).otherwise(low)).alias("e")).select(*keys, "e.v", "e.n", "e.f")


def kl_gain(pair: DataFrame, *keys: str) -> DataFrame:
    """keys, k, ctx, gain: bytes saved by a table of the context's own over the blob's table of followers."""
    keys = keys or ("source_id",)
    parent = pair.groupBy(*keys, "k", "sym").agg(F.sum("n").alias("pn"))
    parent = parent.withColumn("p", F.col("pn") / F.sum("pn").over(Window.partitionBy(*keys, "k")))
    child = pair.withColumn("c", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "k", "ctx")))
    return child.join(parent, [*keys, "k", "sym"]).groupBy(*keys, "k", "ctx").agg((F.sum(F.col("n") * F.log2(F.col("c") / F.col("p"))) / 8).alias("gain"))


def binary(p: Column) -> Column:
    """Entropy of a coin of chance p."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def bit_table(hist: DataFrame, *keys: str) -> DataFrame:
    """keys, bit, flag_ratio, flag_count, aligned_h, aligned_bits, layer_flag_bits, net_bits, net_pct, verdict.

    For each bit: the entropy of the bytes with it cleared, the entropy of its flags, and both against the bytes'
    own entropy in bits; a negative share is a reduction.
    """
    keys = keys or ("source_id",)
    each = hist.select(*keys, "v", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    each = each.withColumn("a", F.expr("v & ~(1 << bit)"))
    a = each.groupBy(*keys, "bit", "a").agg(F.sum("n").alias("n"), F.sum(F.expr("n * ((v >> bit) & 1)")).alias("f"))
    a = order0_of(a.withColumnRenamed("a", "v"), *keys)
    whole = order0(hist, *keys).select(*keys, F.col("h").alias("h0"))
    df = a.join(whole, list(keys)).withColumn("flag_ratio", F.col("flag_count") / F.col("n"))
    df = df.withColumn("aligned_bits", F.col("n") * F.col("aligned_h")).withColumn("layer_flag_bits", F.col("n") * binary(F.col("flag_ratio")))
    df = df.withColumn("net_bits", F.col("aligned_bits") + F.col("layer_flag_bits") - F.col("n") * F.col("h0"))
    df = df.withColumn("net_pct", F.coalesce(F.try_divide(100 * F.col("net_bits"), F.col("n") * F.col("h0")), F.lit(0.0)))
    verdict = F.when(F.round("net_pct", 6) < 0, "reduction").when(F.round("net_pct", 6) > 0, "expansion").otherwise("neutral")
    return df.select(*keys, "bit", "flag_ratio", "flag_count", "aligned_h", "aligned_bits", "layer_flag_bits", "net_bits", "net_pct", verdict.alias("verdict"))


def order0_of(aligned: DataFrame, *keys: str) -> DataFrame:
    sums = aligned.groupBy(*keys, "bit").agg(F.sum("n").alias("n"), F.sum("f").alias("flag_count"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return sums.select(*keys, "bit", "n", "flag_count", (F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n")).alias("aligned_h"))


def net_shares(table: np.ndarray, flags: np.ndarray, n: np.ndarray) -> np.ndarray:
    """net_pct of bit_table: a row for each blob, a column for each bit. table: a row of 256 counts for each blob;
    flags: a row for each bit; n: the blobs' bytes."""
    log = np.log2(n)
    terms = lambda counts: counts * np.log2(np.maximum(counts, 1))
    # Of small blobs there are fewer counts than cells, so each count's term is worked out once.
    known = terms(np.arange(n.max(initial=0) + 1)) if n.max(initial=0) < table.size else None
    h = lambda counts: log - (terms(counts) if known is None else known[counts]).sum(1) / n
    bits, out = n * h(table), np.zeros((len(n), 8))
    for bit in range(8):
        pairs = table.reshape(len(n), -1, 2, 1 << bit)
        p = flags[bit] / n
        mixed = (p > 0) & (p < 1)
        q = np.where(mixed, p, 0.5)
        coin = np.where(mixed, -q * np.log2(q) - (1 - q) * np.log2(1 - q), 0.0)
        net = n * h((pairs[:, :, 0] + pairs[:, :, 1]).reshape(len(n), 128)) + n * coin - bits
        out[:, bit] = np.divide(100 * net, bits, out=np.zeros(len(n)), where=bits != 0)
    return out


def best_bit(table: DataFrame, *keys: str) -> DataFrame:
    """keys, best_entropy_bit, best_entropy_pct: least net share (rounded to 6 places), ties to the lowest bit."""
    keys = keys or ("source_id",)
    return table.groupBy(*keys).agg(F.min(F.struct(F.round("net_pct", 6).alias("p"), "bit")).alias("m")).select(*keys, F.col("m.bit").alias("best_entropy_bit"), F.col("m.p").alias("best_entropy_pct"))


def modulo_probe(blobs: DataFrame, moduli: tuple[int, ...] = (3, 4, 6, 8, 12, 16), *keys: str) -> DataFrame:
    """keys, m, r, n, mean: the mean byte at each residue of the position."""
    keys = keys or ("source_id",)
    each = bytes_of(blobs, *keys).select(*keys, "v", "pos", F.explode(F.array(*map(F.lit, moduli))).alias("m"))
    return each.groupBy(*keys, "m", F.expr("CAST(pos % m AS INT)").alias("r")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def cascade(blobs: DataFrame, *keys: str, first: int = 64, second: int = 128) -> DataFrame:
    """keys, c2, c1, sym, n, level: the table that codes each byte: that of the two bytes before it if seen `second`
    times, else of the one before it if seen `first` times, else the blob's: two left joins and a coalesce."""
    keys = keys or ("source_id",)
    byte = lambda at: byte_at(F.col("data"), at)
    df = blobs.where(F.octet_length("data") > 2).select(*keys, "data", F.explode(F.sequence(F.lit(2), F.octet_length("data") - 1)).alias("pos"))
    three = df.select(*keys, byte(F.col("pos") - 2).alias("c2"), byte(F.col("pos") - 1).alias("c1"), byte(F.col("pos")).alias("sym")).groupBy(*keys, "c2", "c1", "sym").agg(F.count("*").alias("n"))
    two = three.groupBy(*keys, "c2", "c1").agg(F.sum("n").alias("t2")).where(F.col("t2") >= second)
    one = three.groupBy(*keys, "c1").agg(F.sum("n").alias("t1")).where(F.col("t1") >= first)
    df = three.join(two, [*keys, "c2", "c1"], "left").join(one, [*keys, "c1"], "left")
    level = F.when(F.col("t2").isNotNull(), 2).when(F.col("t1").isNotNull(), 1).otherwise(0)
    return df.select(*keys, "c2", "c1", "sym", "n", level.alias("level"))
