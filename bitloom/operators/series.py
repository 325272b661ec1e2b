"""Structure over chunks: decay layers, classes, timeline, transitions, summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from bitloom.operators import entropy, planes

#: What counts as a transition: the class differs, or the halt depth by so much, or the target bit.
HALT_STEP = 3
#: The halt depths' difference from which adaptive chunks are cut.
CUT_STEP = 4
DEEP, SHALLOW = 10, 5


def is_noise(cls: Column) -> Column:
    return F.coalesce(F.lower(cls).rlike("noise|encrypted"), F.lit(False))


def decay(blobs: DataFrame, *keys: str) -> DataFrame:
    """keys, depth, size, odd_count, odd_ratio: layers of parity.

    Layer 0 are the bytes; each next layer is the indices of the odd entries of the one before; the last has none.
    Indices are below the blob's length, so an entry of layer d at index i is odd again or not whatever other blobs
    do: each layer is a filter and a row number, and layers at least halve in two, which bounds their number.
    """
    keys = keys or ("source_id",)

    def layer(x: Column) -> Column:
        return F.filter(F.transform(x, lambda v, i: F.when(v % 2 == 1, i)), lambda i: i.isNotNull())

    first = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: planes.byte_at(F.col("data"), i - 1))
    df = blobs.where(F.octet_length("data") > 0).select(*keys, first.alias("x"))
    start = F.struct(F.col("x").alias("x"), F.array().cast("array<struct<size:int,odd:int>>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        odd = F.size(F.filter(s["x"], lambda v: v % 2 == 1))
        grown = F.concat(s["out"], F.array(F.struct(F.size(s["x"]).alias("size"), odd.alias("odd"))))
        return F.when(F.size(s["x"]) > 0, F.struct(layer(s["x"]).alias("x"), grown.alias("out"))).otherwise(s)

    out = F.aggregate(F.sequence(F.lit(1), (2 * F.ceil(F.log2(F.size("x") + F.lit(1.0))) + 2).cast("int")), start, step, lambda s: s["out"])
    each = df.select(*keys, F.posexplode(out).alias("depth", "l"))
    return each.select(*keys, "depth", F.col("l.size").cast("long").alias("size"), F.col("l.odd").cast("long").alias("odd_count"), (F.col("l.odd") / F.col("l.size")).alias("odd_ratio"))


def fingerprint(layers: DataFrame, planes: DataFrame, uniform: DataFrame, *keys: str) -> DataFrame:
    """keys, cls, halt_depth, l0_odd_ratio, stddev: the class of a chunk from its layers, planes and values.

    One value: "Zero" or "Uniform". Layers past DEEP and flat planes: "Uniform noise / encrypted". Up to SHALLOW
    layers: "Gradient". Else "Structured". The rules are ours.
    """
    keys = keys or ("source_id",)
    depth = layers.groupBy(*keys).agg(F.count("*").alias("halt_depth"), F.max(F.when(F.col("depth") == 0, F.col("odd_ratio"))).alias("l0_odd_ratio"))
    flat = planes.groupBy(*keys).agg(F.stddev_pop(F.col("flags") / F.col("n")).alias("stddev"))
    df = depth.join(flat, list(keys)).join(uniform, list(keys))
    return df.select(*keys, class_of().alias("cls"), "halt_depth", "l0_odd_ratio", "stddev")


def class_of() -> Column:
    """The class by the rules of fingerprint, from all_zero, all_same, halt_depth and stddev."""
    return F.when(F.col("all_zero"), "Zero").when(F.col("all_same"), "Uniform").when((F.col("halt_depth") > DEEP) & (F.col("stddev") < 0.02), "Uniform noise / encrypted").when(F.col("halt_depth") <= SHALLOW, "Gradient").otherwise("Structured")


def complexity(analysis: DataFrame) -> DataFrame:
    """The timeline: a row for each chunk; what a chunk without a fingerprint lacks has fixed values."""
    return analysis.select("source_id", "index", "offset", "size", F.coalesce("cls", F.lit("unknown")).alias("cls"), F.coalesce("halt_depth", F.lit(-1)).cast("int").alias("halt_depth"), F.coalesce("l0_odd_ratio", F.lit(0.0)).alias("l0_odd_ratio"), "primary_target_bit", "best_entropy_bit", "best_entropy_pct")


def transitions(series: DataFrame, halt_step: int = HALT_STEP) -> DataFrame:
    """source_id, before, after (chunk indices), byte_offset, reasons: neighbours that differ in structure."""
    w = Window.partitionBy("source_id").orderBy("index")
    cols = [F.lead(c).over(w).alias(f"next_{c}") for c in ("index", "offset", "cls", "halt_depth", "primary_target_bit")]
    df = series.select("source_id", "index", "cls", "halt_depth", "primary_target_bit", *cols).where("next_index is not null")
    step = F.abs(F.col("next_halt_depth") - F.col("halt_depth"))
    noisy = is_noise(F.col("cls")) & is_noise(F.col("next_cls"))
    reasons = F.array_compact(F.array(
        F.when(F.col("cls") != F.col("next_cls"), F.concat_ws(" -> ", F.concat(F.lit("class "), "cls"), "next_cls")),
        F.when(step >= halt_step, F.concat(F.lit("halt "), F.col("halt_depth").cast("string"), F.lit(" -> "), F.col("next_halt_depth").cast("string"))),
        F.when((F.col("primary_target_bit") != F.col("next_primary_target_bit")) & ~noisy, F.concat(F.lit("bit "), F.col("primary_target_bit").cast("string"), F.lit(" -> "), F.col("next_primary_target_bit").cast("string"))),
    ))
    return df.select("source_id", F.col("index").alias("before"), F.col("next_index").alias("after"), F.col("next_offset").alias("byte_offset"), reasons.alias("reasons")).where(F.size("reasons") > 0)


def summary(series: DataFrame, *keys: str) -> DataFrame:
    """One row for each source: counts, sizes, depths and the distributions of classes and bits."""
    keys = keys or ("source_id",)
    noise = is_noise(F.col("cls"))
    main = series.groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.sum("size").alias("total_bytes"), F.avg("halt_depth").alias("halt_depth_mean"), F.min("halt_depth").alias("halt_depth_min"), F.max("halt_depth").alias("halt_depth_max"), F.count_if(F.col("best_entropy_pct") < -1).alias("n_reduction_chunks"), F.count_if(noise).alias("n_noise_chunks"), (100 * F.count_if(noise) / F.count("*")).alias("compression_skip_pct"))
    dist = lambda c, out: series.groupBy(*keys, c).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(out))
    return main.join(dist("cls", "class_distribution"), list(keys)).join(dist("primary_target_bit", "bit_distribution"), list(keys))


def bit_planes(data: np.ndarray) -> np.ndarray:
    """The eight planes of the bytes of whole words, one after the other: 64 positions a word, the first lowest."""
    u = np.uint64
    ones, gather = u(0x0101010101010101), u(0x0102040810204080)
    return np.concatenate([((((data >> u(bit)) & ones) * gather) >> u(56)).astype(np.uint8).view("<u8") for bit in range(8)])


def parities(blobs: list[np.ndarray]) -> np.ndarray:
    """How many entries each layer has: by depth, bit and blob. Layer 0 are the flags of a bit; each next layer is the
    indices of the odd entries of the one before. There is always a layer 0; the last of several has an entry.

    A layer is a subset of the positions, 64 to a word. An entry goes on to the next layer if an odd number of entries
    of the layer before stands in front of it, which is the parity of a prefix. A blob that is alone is read in pieces
    of STEP bytes: what stands before a piece is the size of the layer so far. Planes that have ended are left out.
    """
    u, sizes = np.uint64, [np.zeros(8 * len(blobs), np.int64)]

    def add(pieces: list[np.ndarray]) -> None:
        words = np.array([max(1, -(-len(x) // 64)) for x in pieces])
        data = np.zeros(64 * int(words.sum()), np.uint8)
        for s, x in zip((64 * (np.cumsum(words) - words)).tolist(), pieces):
            data[s : s + len(x)] = x
        here = bit_planes(data.view("<u8"))
        # An entry of layer 0 goes on if its position is odd.
        odd, at, words, depth = np.full_like(here, 0xAAAAAAAAAAAAAAAA), np.arange(8 * len(pieces)), np.tile(words, 8), 0
        while True:
            n, ends = np.bitwise_count(here), np.cumsum(words)
            before = np.cumsum(n, dtype=np.uint32)
            size = np.diff(before[ends - 1].astype(np.int64), prepend=0)
            live = size > 0
            if not live.any():
                return
            if depth == len(sizes):
                sizes.append(np.zeros(8 * len(blobs), np.int64))
            before -= n
            before ^= np.repeat(before[ends - words] ^ (sizes[depth][at] & 1).astype(np.uint32), words)
            before &= np.uint32(1)
            sizes[depth][at] += size
            if 2 * np.count_nonzero(live) < len(live):
                keep = np.repeat(live, words)
                here, odd, before, words, at = here[keep], odd[keep], before[keep], words[live], at[live]
            there = here & odd
            np.left_shift(here, u(1), out=odd)
            odd |= before
            for k in (1, 2, 4, 8, 16, 32):
                odd ^= np.left_shift(odd, u(k), out=here)
            here, depth = there, depth + 1

    if len(blobs) == 1:
        for i in range(0, len(blobs[0]), planes.STEP):
            add([blobs[0][i : i + planes.STEP]])
    else:
        add(blobs)
    return np.array(sizes).reshape(-1, 8, len(blobs))


def sweep_totals(blobs: DataFrame, *keys: str) -> DataFrame:
    """keys, bit, total, layers: flags of each bit and of the parity layers over their positions. Layers are counted in
    Arrow batches; only the counts are rows. Null and empty blobs have none; rows of equal keys stay apart."""
    keys = keys or ("source_id",)
    df = blobs.where(F.octet_length("data") > 0).select(*keys, "data")
    schema = StructType([*df.schema.fields[:-1]]).add("bit", IntegerType()).add("total", LongType()).add("layers", ArrayType(IntegerType()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data = [np.frombuffer(x, np.uint8) for x in batch.column(len(keys)).to_pylist()]
            for s, e in planes.spans(np.array([len(x) for x in data], np.int64)):
                table = parities(data[s:e]).transpose(2, 1, 0).reshape(8 * (e - s), -1)
                there = table > 0
                there[:, 0] = True
                ends = np.concatenate([[0], np.cumsum(there.sum(1))])
                own = [c.take(pa.array(np.repeat(np.arange(s, e), 8))) for c in batch.columns[:-1]]
                layers = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(table[there].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.tile(np.arange(8, dtype=np.int32), e - s)), pa.array(table.sum(1)), layers], names=[*keys, "bit", "total", "layers"])

    return df.mapInArrow(run, schema)


def primary_bit(totals: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("source_id",)
    return totals.groupBy(*keys).agg(F.min(F.struct("total", "bit"))["bit"].alias("primary_target_bit"))


#: What is measured in each chunk's bytes; net has the share of each bit in entropy.bit_table.
MEASURED = "halt_depth long, l0_odd_ratio double, stddev double, all_zero boolean, all_same boolean, primary_target_bit int, net array<double>"


def measured(blobs: list[np.ndarray]) -> list[pa.Array]:
    """The columns of MEASURED, a row for each blob; an empty one has nulls."""
    n = np.array([len(b) for b in blobs], np.int64)
    table, swept, some = planes.counted(blobs), parities(blobs), np.maximum(n, 1)
    flags = swept[0]
    # Layers start from the bytes, and the next one is where they are odd: bit 0's flags.
    columns = [1 + (swept[:, 0] > 0).sum(0), flags[0] / some, (flags / some).std(0), table[:, 0] == n, table.max(1) == n]
    columns.append(np.argmin(swept.sum(0), 0).astype(np.int32))
    net = entropy.net_shares(table, flags, some)
    none = n == 0
    return [*(pa.array(c, mask=none) for c in columns), pa.ListArray.from_arrays(pa.array(np.arange(0, net.size + 1, 8, dtype=np.int32)), pa.array(net.ravel()), mask=pa.array(none))]


def analysed(chunks: DataFrame) -> DataFrame:
    """source_id, index, offset, size, data and the timeline's columns of each chunk: the whole analysis in one pass.

    Each row is analysed by itself, without a shuffle: also rows without a source and rows of equal keys. Chunks
    without bytes have nulls.
    """
    schema, at = chunks.schema, chunks.columns.index("data")
    out = StructType([*schema.fields, *StructType.fromDDL(MEASURED).fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data = [np.frombuffer(x or b"", np.uint8) for x in batch.column(at).to_pylist()]
            for s, e in planes.spans(np.array([len(x) for x in data], np.int64)):
                yield pa.RecordBatch.from_arrays([*batch.slice(s, e - s).columns, *measured(data[s:e])], names=out.names)

    df = chunks.mapInArrow(run, out).withColumn("best", F.array_min(F.transform("net", lambda p, bit: F.struct(F.round(p, 6).alias("p"), bit.alias("bit")))))
    cls = F.when(F.col("halt_depth").isNotNull(), class_of())
    return df.select(*schema.names, cls.alias("cls"), "halt_depth", "l0_odd_ratio", "stddev", "primary_target_bit", F.col("best.bit").alias("best_entropy_bit"), F.col("best.p").alias("best_entropy_pct"))


def frame_log(line: DataFrame) -> DataFrame:
    """source_id, index, value: a timeline's rows as text, for write.text partitioned by source."""
    text = F.format_string("chunk %06d  offset %d  size %d\n  class %s  halt depth %d  odd ratio %.4f\n  target bit %s  entropy bit %s (%s %%)", "index", "offset", "size", "cls", "halt_depth", "l0_odd_ratio", F.col("primary_target_bit").cast("string"), F.col("best_entropy_bit").cast("string"), F.round("best_entropy_pct", 2).cast("string"))
    return line.select("source_id", "index", text.alias("value"))
