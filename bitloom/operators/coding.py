"""Encoders over DataFrames of blobs, as Arrow batches; planning and comparing stay in SQL."""

from __future__ import annotations

import bz2
import hashlib
import lzma
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import codecs
from bitloom.operators import series

#: Compressors of the corpus comparison that need nothing but the standard library.
COMPRESSORS: dict[str, Callable[[bytes], bytes]] = {"gzip": codecs.gzip_encode, "bzip2": lambda d: bz2.compress(d, 9), "xz": lambda d: lzma.compress(d, preset=9), "deflate": lambda d: zlib.compress(d, 9), "planes": codecs.encode}


def _rows(blobs: DataFrame, keys: list[str], schema: str, each: Callable[..., Iterator[tuple]]) -> DataFrame:
    """A generator's rows for each blob, behind the blob's keys."""
    kinds = dict(blobs.dtypes)
    full = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, of = [], []
            for i, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for r in each(data or b""):
                    rows.append(r)
                    of.append(i)
            take = pa.array(of, pa.int64())
            names = [c.rsplit(" ", 1)[0].strip() for c in schema.split(",")]
            kind = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
            types = [kind[c.rsplit(" ", 1)[1].strip()] for c in schema.split(",")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(take) for j in range(len(keys))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*keys, *names])

    return blobs.select(*keys, "data").mapInArrow(run, full)


def codec_roundtrip(blobs: DataFrame, *names: str) -> DataFrame:
    """source_id, codec, size, encoded, ok of each blob under byte codecs."""

    def each(data: bytes):
        for n in names or codecs.BYTES:
            put, get = codecs.BYTES[n]
            packed = put(data)
            yield n, len(data), len(packed), hashlib.sha256(get(packed)).digest() == hashlib.sha256(data).digest()

    return _rows(blobs, ["source_id"], "codec string, size long, encoded long, ok boolean", each)


def plane_roundtrip(blobs: DataFrame, *names: str) -> DataFrame:
    """source_id, bit, fmt, flags, encoded, ok of each plane under plane codecs."""

    def each(data: bytes):
        x = np.frombuffer(data, np.uint8)
        for bit in range(8):
            plane = (x >> bit & 1).astype(np.uint8)
            for n in names or codecs.PLANES:
                _, put, get = codecs.PLANES[n]
                packed = put(plane)
                yield bit, n, int(plane.sum()), len(packed), bool((get(packed, len(plane)) == plane).all())

    return _rows(blobs, ["source_id"], "bit int, fmt string, flags long, encoded long, ok boolean", each)


def encoded(blobs: DataFrame, mode: str = "auto") -> DataFrame:
    """source_id, size, container."""
    return _rows(blobs, ["source_id"], "size long, container binary", lambda d: iter([(len(d), codecs.encode(d, mode))]))


def decoded(containers: DataFrame, verify: bool = True) -> DataFrame:
    """source_id, data of containers; a wrong hash raises when verify is set."""
    df = containers.select("source_id", F.col("container").alias("data"))
    return _rows(df, ["source_id"], "content binary", lambda d: iter([(codecs.decode(d, verify),)])).withColumnRenamed("content", "data")


def roundtrip(blobs: DataFrame, mode: str = "auto") -> DataFrame:
    """source_id, size, encoded, ratio, ok: whole-blob formats, checked by SHA-256 in the plan."""
    packed = encoded(blobs, mode)
    back = decoded(packed).select("source_id", F.sha2("data", 256).alias("back"))
    df = packed.join(back, "source_id").join(blobs.select("source_id", F.sha2("data", 256).alias("sha")), "source_id")
    return df.select("source_id", "size", F.octet_length("container").cast("long").alias("encoded"), F.try_divide(F.octet_length("container"), "size").alias("ratio"), (F.col("back") == F.col("sha")).alias("ok"))


def header(containers: DataFrame) -> DataFrame:
    """source_id, magic, mode, size, sha256 read from the containers' first bytes."""
    from bitloom.sources.blobs import uint_be

    c = F.col("container")
    return containers.select("source_id", F.substring(c, 1, 4).cast("string").alias("magic"), uint_be(c, 4, 1).cast("int").alias("mode"), uint_be(c, 6, 7).alias("size"), F.lower(F.hex(F.substring(c, 14, 32))).alias("sha256"))


def chunk_records(chunks: DataFrame) -> DataFrame:
    """source_id, index, offset, target_bit, size, encoded, record of analysed chunks (with cls, target_bit, data).

    A chunk of a noise class is only compressed, without a plane of its own.
    """
    df = chunks.withColumn("target_bit", F.when(series.is_noise(F.col("cls")), codecs.RAW).otherwise(F.col("target_bit")).cast("int"))
    tagged = df.withColumn("data", F.concat(F.unhex(F.lpad(F.hex("target_bit"), 2, "0")), "data"))
    return _rows(tagged, ["source_id", "index", "offset"], "target_bit int, size long, encoded long, record binary", lambda d: iter([(d[0], len(d) - 1, len(r := codecs.chunk_encode(d[1:], d[0])), r)]))


def chunk_containers(records: DataFrame) -> DataFrame:
    """source_id, n_chunks, container: the chunks' records in order."""
    ordered = F.sort_array(F.collect_list(F.struct("index", "record")))
    return records.groupBy("source_id").agg(F.count("*").alias("n_chunks"), ordered.alias("r")).select("source_id", "n_chunks", F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["record"])), "")).alias("container"))


def chunk_headers(containers: DataFrame) -> DataFrame:
    """source_id, index, target_bit, size, encoded of each record; payloads are skipped."""
    df = containers.select("source_id", F.col("container").alias("data"))
    return _rows(df, ["source_id"], "index long, target_bit int, size long, encoded long", lambda d: ((i, b, n, e) for i, (_, b, n, e) in enumerate(codecs.chunk_headers(d))))


def chunk_contents(containers: DataFrame) -> DataFrame:
    """source_id, index, data of each record."""
    df = containers.select("source_id", F.col("container").alias("data"))
    return _rows(df, ["source_id"], "index long, content binary", lambda d: ((i, codecs.chunk_decode(d[at:])) for i, (at, *_) in enumerate(codecs.chunk_headers(d)))).withColumnRenamed("content", "data")


def compressor_bench(blobs: DataFrame) -> DataFrame:
    """source_id, codec, size, encoded for each compressor: the cross product of blobs and compressors."""
    return _rows(blobs, ["source_id"], "codec string, size long, encoded long", lambda d: ((n, len(d), len(f(d))) for n, f in COMPRESSORS.items()))


def corpus(bench: DataFrame) -> DataFrame:
    """codec, source_id (null for the whole codec, both null for all), size, encoded, ratio."""
    df = bench.rollup("codec", "source_id").agg(F.sum("size").alias("size"), F.sum("encoded").alias("encoded"))
    return df.withColumn("ratio", F.try_divide("encoded", "size"))


def inspect_sizes(blobs: DataFrame) -> DataFrame:
    """source_id, depth, bit, flag_bytes, ans_bytes, terminal: what each level of the recursive format costs."""

    def each(data: bytes):
        x, depth, rows = np.frombuffer(data, np.uint8), 0, []
        while len(x) and depth < 8 and x.any() and not (x == 1).all():
            bit = int(np.argmin([(x >> b & 1).sum() for b in range(8 - depth)]))
            aligned = x & ~np.uint8(1 << bit)
            rows.append((depth, bit, len(codecs.race((x >> bit & 1).astype(np.uint8))[1]), len(codecs.stride_encode(aligned.tobytes()))))
            x, depth = codecs.squeeze(aligned, bit), depth + 1
        end = codecs.LEVEL.size + (len(codecs.gzip_encode(x.tobytes())) if not len(x) or x.any() and not (x == 1).all() else 0)
        yield from ((*r, end) for r in rows)

    return _rows(blobs, ["source_id"], "depth int, bit int, flag_bytes long, ans_bytes long, terminal long", each)


def backend_bench(blobs: DataFrame, bit: int | None = None) -> DataFrame:
    """source_id, backend, bit, size, encoded, ok of the one-plane format with each coder of the rest, and the best."""

    def each(data: bytes):
        for rest in (None, *codecs.REST):
            packed = codecs.single_encode(data, bit, rest)
            yield rest or "auto", packed[0], len(data), len(packed), codecs.single_decode(packed) == data

    return _rows(blobs, ["source_id"], "backend string, bit int, size long, encoded long, ok boolean", each)


def bit_choices(blobs: DataFrame, cap: int = 0) -> DataFrame:
    """source_id, sparsest, cheapest: the target bit by count and by encoded size."""
    return _rows(blobs, ["source_id"], "sparsest int, cheapest int", lambda d: iter([(codecs.sparsest_bit(d), codecs.cheapest_bit(d, cap))] if d else []))


def compressed_flags(blobs: DataFrame, bit: int) -> DataFrame:
    """source_id, enc_bitset_gz, enc_delta_gz: gzip sizes of the bitset and the gap list; not tried up to 32 bytes."""

    def each(data: bytes):
        plane = (np.frombuffer(data, np.uint8) >> bit & 1).astype(np.uint8)
        raw = codecs.bits_out(plane), codecs.gap_encode(plane)
        yield tuple(len(codecs.gzip_encode(r)) if len(r) > 32 else len(r) for r in raw)

    return _rows(blobs, ["source_id"], "enc_bitset_gz long, enc_delta_gz long", each)


def run_log(blobs: DataFrame, mode: str = "auto") -> DataFrame:
    """source_id, section, key, value: what an encoder run reports, as rows in place of a log file."""
    packed = encoded(blobs, mode)
    head = header(packed).join(packed.select("source_id", F.octet_length("container").alias("encoded")), "source_id")
    pair = lambda section, key, value: F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.cast("string").alias("value"))
    rows = F.array(pair("input", "size", F.col("size")), pair("input", "sha256", F.col("sha256")), pair("output", "mode", F.col("mode")), pair("output", "size", F.col("encoded")), pair("output", "ratio", F.round(F.try_divide("encoded", "size"), 4)))
    return head.select("source_id", F.explode(rows).alias("r")).select("source_id", "r.*")
