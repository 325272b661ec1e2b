"""Each stage of the pipeline on its own input, against plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest

from bitloom.llm import decontaminate, mixing, near_dedup, quality, sharding
from bitloom.llm.common import stored, table

from .test_exact import TERMS, WORDS, low

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, DATA), name)
        out.append((docs, after))
        docs = after
    return out


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes
    assert {"doc_id", "text", "shard", "slot"} <= set(steps[-1][1].columns)


def test_quality_stage(spark, steps):
    before, after = steps[0]
    model = quality.learn(before, table(spark, DATA, "labels"))
    rows = before.select("doc_id", "text").collect()
    roller = quality.Roller(2)
    want = {r.doc_id for r in rows if model.scores([r.text.encode()], roller)[0] >= 0.3}
    assert {r.doc_id for r in after.collect()} == want
    good = {r.doc_id for r in table(spark, DATA, "labels").where("quality = 1").collect()}
    ids = {r.doc_id for r in rows}
    assert len(good & ids & want) >= 0.95 * len(good & ids)


def test_near_copies_stage(steps):
    before, after = steps[1]
    sets = {}
    for r in before.collect():
        w = WORDS.findall(low(r.text))
        sets[r.doc_id] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in after.collect()} == {i for i in sets if root(i) == i}


def test_decontamination_stage(spark, steps):
    before, after = steps[2]
    wins = set()
    for r in table(spark, DATA, "benchmark").collect():
        w = TERMS.findall(low(r.text))
        wins |= {tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in wins}
    clean = set()
    for r in before.collect():
        w = TERMS.findall(low(r.text))
        if not any(tuple(w[a : a + n]) in wins for n in sizes for a in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == clean and len(clean) < before.count()


def test_mixing_stage(steps):
    before, after = steps[3]
    text = {r.doc_id: r.text for r in before.collect()}
    got = Counter(r.doc_id for r in after.collect())
    assert all(text[r.doc_id] == r.text for r in after.collect())
    taken, size = defaultdict(int), defaultdict(int)
    for r in mixing.mix(before).collect():
        taken[r.doc_id], size[r.doc_id] = taken[r.doc_id] + r.taken, size[r.doc_id] + r.size
    assert all(abs(got[i] - taken[i] / max(1, size[i])) <= 0.5 for i in text)


def test_sharding_stage(steps):
    before, after = steps[4]
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert key(before) == key(after)
    by = defaultdict(list)
    for r in after.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))


def test_whole_run(spark, steps):
    assert corpus_pipeline.run(spark, DATA).count() == steps[-1][1].count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]


def test_rewriting_only_changed_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 9, 0 if i < 8 else i % 3) for i in range(16)], "doc_id long, text string, at int")
    out = sharding.reshard(docs, docs["at"], 3)
    changed = {r.shard for r in sharding.rewrite(out, str(tmp_path / "shards")).collect()}
    moved = {s for r in out.collect() if r.old != r.shard for s in (r.old, r.shard)}
    assert changed == moved
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} <= {f"shard={s}" for s in changed}


def test_stage_modules_import_nothing_private():
    assert not re.search("localCheckpoint", "".join(open(m.__file__).read() for m in (decontaminate, mixing, quality, sharding, corpus_pipeline)))


def sizes(it):
    """Rows and bytes of each batch, in the first two columns of a sketch."""
    for b in it:
        yield pa.RecordBatch.from_pylist([{"doc_id": b.num_rows, "n_shingles": b.nbytes, "same1": 0, "same2": 0, "sig": b"", "keys": []}], pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("same1", pa.int64()), ("same2", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))]))


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_dedup, "sketch_batches", sizes)
    docs = spark.range(0, 8000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 700).alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    got = near_dedup.sketches(docs).collect()
    assert sum(r.doc_id for r in got) == 8000 and max(r.n_shingles for r in got) <= 4 << 20
