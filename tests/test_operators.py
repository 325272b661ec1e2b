from __future__ import annotations

import os
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import codecs
from bitloom.operators import chunking, coding, entropy, planes, positions, race, series
from bitloom.plans import catalogue
from bitloom.sources import blobs, generators
from bitloom.streaming import chunks as streaming

EDGE = [("empty", b""), ("one", b"a"), ("zero", bytes(40)), ("ones", b"\1" * 40), ("threes", b"\3" * 9), ("full", b"\xff" * 9), ("text", b"Some text, some more text."), ("random", np.random.default_rng(1).bytes(4097)), ("last", bytes(99) + b"\x80")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(n, bytearray(d)) for n, d in EDGE], "source_id string, data binary")


def test_chunks_put_together(edge):
    for df in (chunking.chunked(edge, chunk_size=7), chunking.chunked(edge, width=2, height=2), chunking.chunked(edge, frame_size=50), chunking.chunked(edge)):
        got: dict[str, bytes] = {}
        for r in df.orderBy("source_id", "index").collect():
            assert r.offset == len(got.get(r.source_id, b"")) and r.size == len(r.data)
            got[r.source_id] = got.get(r.source_id, b"") + bytes(r.data)
        assert got == {n: d for n, d in EDGE if d}
    with pytest.raises(ValueError, match="positive"):
        chunking.fixed(edge, 0)


def test_levels_follow_the_encoder(edge):
    """Depths and bits that SQL plans are those of an encoder that sweeps again at each level."""
    rank = planes.ranked(planes.popcounts(planes.histogram(edge)))
    got: dict[str, list] = {}
    for r in planes.levels(rank).orderBy("source_id", "depth").collect():
        got.setdefault(r.source_id, []).append(r.rank_bit)
    plain: dict[str, list] = {}
    for r in planes.levels(rank, plain=True).orderBy("source_id", "depth").collect():
        plain.setdefault(r.source_id, []).append(r.bit)
    for name, data in EDGE:
        x, want = np.frombuffer(data, np.uint8), []
        while len(x) and len(want) < 8 and x.any() and not (x == 1).all():
            bit = int(np.argmin([(x >> b & 1).sum() for b in range(8 - len(want))]))
            want.append(bit)
            x = codecs.squeeze(x & ~np.uint8(1 << bit), bit)
        assert got.get(name, []) == want
        packed = codecs.concatenated_encode(data)
        assert plain.get(name, []) == list(packed[1 : 1 + packed[0]])


@pytest.mark.parametrize("bit", [0, 5, 7])
def test_closed_form_sizes(edge, bit):
    for r in positions.sizes(positions.flags(edge, bit)).collect():
        plane = (np.frombuffer(dict(EDGE)[r.source_id], np.uint8) >> bit & 1).astype(np.uint8)
        assert (r.bitset, r.gap, r.ef, r.rle) == tuple(len(f(plane)) for f in (codecs.bits_out, codecs.gap_encode, codecs.ef_encode, codecs.rle_encode))


def test_normalised(spark):
    many = {v: 1 for v in range(200)} | {250: 10**7, 251: 10**6}
    few = {1: 3, 2: 3, 3: 3}
    rows = [(k, v, n) for k, d in (("many", many), ("few", few)) for v, n in d.items()]
    got = entropy.normalised(spark.createDataFrame(rows, "source_id string, v int, n long")).collect()
    for name, d in (("many", many), ("few", few)):
        assert {r.v: r.f for r in got if r.source_id == name} == codecs.normalise(d)


def test_stride(spark):
    words = np.cumsum(np.random.default_rng(5).integers(-3, 4, 3000)).astype("<i8").tobytes()
    df = spark.createDataFrame([("records", bytearray(words))], "source_id string, data binary")
    r = entropy.stride(entropy.conditional(entropy.pairs(df, entropy.STRIDES))).first()
    assert r.k == codecs.choose_stride(words) == 8


def test_entropy_by_stride(spark):
    """One pass over bytes agrees with the entropy of the pairs, and a blob within the stride has the fixed value."""
    r = np.random.default_rng(3)
    data = [("big", r.integers(0, 9, 300_000)), ("small", r.integers(0, 200, 90)), ("tiny", np.arange(3)), ("none", np.arange(0))]
    df = spark.createDataFrame([(n, bytearray(x.astype(np.uint8).tobytes())) for n, x in data], "source_id string, data binary")
    got = {(r.source_id, r.k): r.h for r in entropy.by_stride(df).collect()}
    want = {(r.source_id, r.k): r.h for r in entropy.conditional(entropy.pairs(df, entropy.STRIDES)).collect()}
    assert len(got) == 4 * len(entropy.STRIDES)
    for (n, k), h in got.items():
        assert abs(h - want.get((n, k), entropy.NO_CONTEXT)) < 1e-9
    assert ("tiny", 2) in want and ("tiny", 3) not in want


def test_histogram_of_large_blobs(spark):
    x = np.random.default_rng(4).integers(0, 256, planes.STEP + 77).astype(np.uint8)
    df = spark.createDataFrame([("a", bytearray(x.tobytes())), ("b", None), ("b", bytearray()), ("c", bytearray(b"xyx")), ("c", bytearray(b"z"))], "source_id string, data binary")
    got = {(r.source_id, r.v): r.n for r in planes.histogram(df).collect()}
    assert got == {("a", v): n for v, n in enumerate(np.bincount(x, minlength=256).tolist())} | {("c", 120): 2, ("c", 121): 1, ("c", 122): 1}


def test_pairs_of_a_whole_blob(spark):
    """Pairs beyond the bytes that the stride choice looks at count too."""
    n = entropy.SAMPLE_BYTES + 40
    df = spark.createDataFrame([("s", bytearray(b"a" * (n - 40) + b"b" * 40))], "source_id string, data binary")
    got = {(r.ctx, r.sym): r.n for r in entropy.pairs(df).collect()}
    assert got == {(97, 97): n - 41, (97, 98): 1, (98, 98): 39}
    assert {(r.ctx, r.sym): r.n for r in entropy.pairs(df, sample=entropy.SAMPLE_BYTES).collect()} == {(97, 97): n - 41}


def test_cutoff(spark):
    levels = [(100, 10), (100, 500), (5, 500)]
    df = spark.createDataFrame([(levels, 50)], "l array<struct<flag_bytes:long,ans_bytes:long>>, t long")
    c = df.select(race.cutoff(F.col("l"), F.col("t")).alias("c")).first().c
    assert (c.cost, c.depth) == (11 + 100 + 10, 0)


def test_plan_costs_what_the_encoder_writes(edge):
    level = F.sort_array(F.collect_list(F.struct("depth", "flag_bytes", "ans_bytes")))
    df = coding.inspect_sizes(edge).groupBy("source_id").agg(level.alias("l"), F.max("terminal").alias("t"))
    got = {r.source_id: r.cost for r in df.select("source_id", race.cutoff(F.col("l"), F.col("t"))["cost"].alias("cost")).collect()}
    assert got == {n: len(codecs.recursive_encode(d)) for n, d in EDGE if n in got}
    assert {"text", "random", "last"} <= set(got)


def test_decay(edge):
    got: dict[str, list] = {}
    for r in series.decay(edge, "source_id").orderBy("source_id", "depth").collect():
        got.setdefault(r.source_id, []).append((r["size"], r.odd_count))
    for name, data in EDGE:
        x, want = list(data), []
        while x:
            odd = [i for i, v in enumerate(x) if v % 2]
            want.append((len(x), len(odd)))
            x = odd
        assert got.get(name, []) == want[:40]


def test_transitions_and_boundaries(spark):
    rows = [("s", i, i * 100, 100, cls, halt, bit) for i, (cls, halt, bit) in enumerate([("A", 2, 1), ("A", 2, 1), ("B", 2, 1), ("B", 6, 1), ("B", 6, 2), ("Noise", 6, 2), ("encrypted", 6, 4), (None, 6, 4)])]
    df = spark.createDataFrame(rows, "source_id string, index long, offset long, size long, cls string, halt_depth int, primary_target_bit int")
    df = df.withColumns({"l0_odd_ratio": F.lit(0.5), "best_entropy_bit": F.lit(1), "best_entropy_pct": F.lit(-2.0)})
    line = series.complexity(df)
    got = {r.before: r.reasons for r in series.transitions(line).collect()}
    assert got == {1: ["class A -> B"], 2: ["halt 2 -> 6"], 3: ["bit 1 -> 2"], 4: ["class B -> Noise"], 5: ["class Noise -> encrypted"], 6: ["class encrypted -> unknown"]}
    bounds = [r.offset for r in chunking.boundaries(series.transitions(line), 256).orderBy("nth").collect()]
    assert bounds == [0, 300, 600]
    sizes = spark.createDataFrame([("s", 800)], "source_id string, size long")
    assert [r["size"] for r in chunking.regions(chunking.boundaries(series.transitions(line), 256), sizes).orderBy("nth").collect()] == [300, 300, 200]
    s = series.summary(line).first()
    assert (s.n_chunks, s.total_bytes, s.n_noise_chunks, s.n_reduction_chunks) == (8, 800, 2, 8)
    assert s.class_distribution == {"A": 2, "B": 3, "Noise": 1, "encrypted": 1, "unknown": 1}
    assert series.summary(line.limit(0)).count() == 0


def test_containers(edge):
    packed = coding.encoded(edge)
    head = {r.source_id: r for r in coding.header(packed).collect()}
    assert all(head[n].magic == "BLM1" and head[n]["size"] == len(d) for n, d in EDGE)
    assert {r.source_id: bytes(r.data) for r in coding.decoded(packed).collect()} == dict(EDGE)


def test_noise_chunks_go_without_a_plane(spark):
    df = spark.createDataFrame([("s", 0, 0, "Uniform noise / encrypted", 3, bytearray(b"abc")), ("s", 1, 3, "Structured", 3, bytearray(b"def"))], "source_id string, index long, offset long, cls string, target_bit int, data binary")
    records = coding.chunk_records(df)
    heads = coding.chunk_headers(coding.chunk_containers(records)).orderBy("index").collect()
    assert [(h.target_bit, h["size"]) for h in heads] == [(codecs.RAW, 3), (3, 3)]
    parts = coding.chunk_contents(coding.chunk_containers(records)).orderBy("index").collect()
    assert [bytes(p.data) for p in parts] == [b"abc", b"def"]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "below").mkdir(parents=True)
    for name, data in EDGE[:4]:
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "in" / "below" / "deep").write_bytes(b"deep")
    got = {os.path.basename(r.source_id): r["size"] for r in blobs.inventory(blobs.files(spark, str(tmp_path / "in"))).collect()}
    assert got == {n: len(d) for n, d in EDGE[:4] if d}
    assert blobs.files(spark, str(tmp_path / "in"), recursive=True).count() == 4


def test_generators(spark):
    assert [r.v for r in generators.prime_gaps(spark, 10).orderBy("pos").collect()] == [1, 2, 2, 4, 2, 4, 2, 4, 6, 2]
    assert [r.v for r in generators.fibonacci(spark, 16).orderBy("pos").collect()] == [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 121, 98]


def test_streams(spark, tmp_path, edge):
    edge.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, data binary").parquet(str(tmp_path / "in"))
    got = streaming.drained(streaming.chunk_stats(stream, 16), str(tmp_path / "out"))
    pop = planes.popcounts(planes.histogram(chunking.fixed(edge, 16), "source_id", "index"), "source_id", "index").where("bit = 5")
    assert {(r.source_id, r["index"], r.flags) for r in pop.collect()} == {(r.source_id, r["index"], r.p5) for r in got.collect()}
    changes = streaming.drained(streaming.target_changes(streaming.chunk_stats(spark.readStream.schema("source_id string, data binary").parquet(str(tmp_path / "in")), 16)), str(tmp_path / "changes"))
    assert all(r.before != r.after for r in changes.collect())
    assert set(changes.columns) >= {"source_id", "before", "after"}


def test_sweep_totals(edge):
    got = {(r.source_id, r.bit): (r.total, list(r.layers)) for r in series.sweep_totals(edge).collect()}
    for name, data in EDGE:
        for bit in range(8) if data else ():
            x = [i for i, v in enumerate(data) if v >> bit & 1]
            layers = [len(x)]
            while x := [i for i, v in enumerate(x) if v % 2]:
                layers.append(len(x))
            assert got[name, bit] == (sum(layers), layers)


def test_sweep_totals_of_large_blobs(spark):
    """Layers go on over pieces of a blob, and 4 MB take seconds: an interpreted fold took more than a minute."""
    rows = [("long", np.random.default_rng(2).bytes(3 * planes.STEP + 777)), ("a", b"odd \xff"), ("a", b"x"), ("ones", b"\1" * (planes.STEP + 1)), (None, b"y")]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "source_id string, data binary").coalesce(1)
    start = time.perf_counter()
    got = Counter((r.source_id, r.bit, r.total, tuple(r.layers)) for r in series.sweep_totals(df).collect())
    assert time.perf_counter() - start < 20
    want = Counter()
    for name, data in rows:
        for bit in range(8):
            x = np.flatnonzero(np.frombuffer(data, np.uint8) >> bit & 1)
            layers = [len(x)]
            while len(x := np.flatnonzero(x & 1)):
                layers.append(len(x))
            want[name, bit, sum(layers), tuple(layers)] += 1
    assert got == want


def layers_as_lists(blobs, bit):
    """Sizes of a bit's layers by depth and blob, each layer as a list of indices."""
    sizes, odd, bounds = [], (np.concatenate(blobs) >> bit & 1).view(bool), np.cumsum([0, *map(len, blobs)])
    while len(here := np.flatnonzero(odd)):
        inner = np.searchsorted(here, bounds)
        sizes.append(np.diff(inner))
        odd, bounds = ((here - np.repeat(bounds[:-1], np.diff(inner))) & 1).view(np.uint8)[::8].view(bool), inner
    return sizes


def test_analysis_takes_less_time_than_listing_layers():
    """Of all that is measured in chunks, the layers took most time: as lists of indices they alone take longer than the
    whole analysis of words of 64 positions."""
    r = np.random.default_rng(4)
    short = [r.integers(0, 256, r.integers(0, 200), dtype=np.uint8) & np.uint8(r.integers(0, 256)) for _ in range(500)]
    text = np.frombuffer(b" ".join(r.choice([b"the", b"layers", b"of", b"any", b"text", b"are", b"short", "zählt".encode()], 90_000)), np.uint8)
    chunks = [text[i : i + 2048] for i in range(0, len(text), 2048)]
    for blobs in short, chunks:
        want = [layers_as_lists(blobs, bit) for bit in range(8)]
        got = [c.to_pylist() for c in series.measured(blobs)]
        depth, bit = sum((n > 0).astype(int) for n in want[0]), np.argmin([sum(w, np.zeros(len(blobs))) for w in want], 0)
        assert [(got[0][i], got[5][i]) for i, x in enumerate(blobs) if len(x)] == [(1 + depth[i], bit[i]) for i, x in enumerate(blobs) if len(x)]
        assert all(c[i] is None for c in got for i, x in enumerate(blobs) if not len(x))

    def least(f):
        took = []
        for _ in range(7):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert least(lambda: series.measured(chunks)) < least(lambda: [layers_as_lists(chunks, bit) for bit in range(8)])


def test_analysis_in_one_pass(spark, edge):
    """As the operators on layers, planes and values have it, but each row by itself and without a shuffle."""
    keys = ["source_id", "index"]
    chunks = chunking.fixed(edge, 700)
    hist = planes.histogram(chunks, *keys)
    want = series.fingerprint(series.decay(chunks, *keys), planes.popcounts(hist, *keys), planes.uniformity(hist, *keys), *keys)
    want = want.join(series.primary_bit(series.sweep_totals(chunks, *keys), *keys), keys).join(entropy.best_bit(entropy.bit_table(hist, *keys), *keys), keys)
    plain = lambda df: {tuple(r)[:2]: [round(v, 9) if isinstance(v, float) else v for v in r[2:]] for r in df.collect()}
    df = series.analysed(chunks)
    assert plain(df.drop("offset", "size", "data")) == plain(want) != {}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "aggregate(" not in plan
    odd = series.analysed(chunks.limit(0).union(spark.createDataFrame([(n, 0, 0, len(d), bytearray(d)) for n, d in ((None, b"a text"), ("x", b"aa"), ("x", bytes(3)), ("no", b""))], chunks.schema)))
    assert sorted((str(r.source_id), str(r.cls), r["size"]) for r in odd.collect()) == [("None", "Gradient", 6), ("no", "None", 0), ("x", "Uniform", 2), ("x", "Zero", 3)]
    assert [r.cls for r in series.complexity(odd.where("size = 0")).collect()] == ["unknown"]


def test_frame_log_of_every_chunk(spark):
    """Also of chunks without a source, and without a shuffle."""
    chunks = chunking.fixed(spark.createDataFrame([(None, bytearray(b"aaa")), ("x", bytearray(5))], "source_id string, data binary"), 4)
    log = series.frame_log(series.complexity(series.analysed(chunks)))
    assert "Exchange" not in log._jdf.queryExecution().executedPlan().toString()
    heads = {(r.source_id, r["index"]): [line.strip() for line in r.value.split("\n")][:2] for r in log.collect()}
    assert heads == {
        (None, 0): ["chunk 000000  offset 0  size 3", "class Uniform  halt depth 4  odd ratio 1.0000"],
        ("x", 0): ["chunk 000000  offset 0  size 4", "class Zero  halt depth 1  odd ratio 0.0000"],
        ("x", 1): ["chunk 000001  offset 4  size 1", "class Zero  halt depth 1  odd ratio 0.0000"],
    }


def test_rows_of_one_split_are_spread(spark, tmp_path):
    """One row group was one task, however many cores there are. Equal keys, and rows without one, are dealt too."""
    rows = [(None if i % 3 else 7, f"text {i}") for i in range(400)] + [(None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    split = F.spark_partition_id().alias("split")
    dealt = blobs.documents(spark, str(tmp_path), even=True)
    assert max(r["count"] for r in dealt.groupBy(split).count().collect()) < 100
    plain = lambda df: Counter((r.source_id, bytes(r.data)) for r in df.collect())
    assert plain(dealt) == plain(blobs.documents(spark, str(tmp_path))) and sum(plain(dealt).values()) == 402
    log = catalogue.frame_log(spark, str(tmp_path))
    assert len({r.split for r in log.select(split).collect()}) > 3 and log.count() == 400
    whole = df.repartition(4)
    assert blobs.spread(whole) is whole and blobs.spread(df.limit(0)).count() == 0


def test_profile_of_a_plane(spark):
    data = bytes([1, 0, 0, 1, 1, 0, 0, 0, 1])
    df = spark.createDataFrame([("s", bytearray(data)), ("none", bytearray(4))], "source_id string, data binary")
    got = {r.source_id: r for r in positions.profile(df, 0, coding.compressed_flags(df, 0)).collect()}
    r = got["s"]
    assert (r.k, r.n, r.gap_min, r.gap_max, r.gap_mean) == (4, 9, 0, 4, 2.0)
    assert (r.run_set_max, r.run_set_mean, r.run_clear_max, r.run_clear_mean) == (2, 4 / 3, 3, 2.5)
    assert (r.enc_bitset, r.enc_delta_raw, r.enc_best, r.enc_best_method) == (2, 8, 2, "bitset")
    assert (got["none"].k, got["none"].enc_delta_raw, got["none"].gap_min) == (0, 4, None)


def test_sql_functions(spark, edge):
    from bitloom.functions import udfs

    udfs.register(spark)
    edge.createOrReplaceTempView("edge")
    same = spark.sql("SELECT decode_blob(encode_blob(data)) = data AND ans1_decode(ans1_encode(data)) = data AS same, encode_blob(NULL) AS none FROM edge").collect()
    assert len(same) == len(EDGE) and all(r.same and r.none is None for r in same)
