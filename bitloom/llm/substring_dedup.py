"""Exact substring dedup with a log-structured fingerprint index.

A window is 50 consecutive words. Its fingerprint is the least hash among its 31 runs of 20 words, so equal windows
have equal fingerprints and neighbours mostly share one: an index row for about 16 windows.

1. Index: each batch's fingerprints are merge-joined with the sorted immutable runs of earlier batches, bucketed alike
   so that neither is shuffled for it, and are a run themselves. FANOUT runs of a level are compacted into one of the
   next, whose files replace theirs. What comes out is the fingerprints that stand in two documents.
2. Verify: only windows with such a fingerprint go on, each with a SHA-256 digest of its 50 words (128 bits kept), and a
   window is removed if its digest stands in a document of smaller doc_id. Rolling hashes propose, digests decide.
Whole copies of a document are found by a digest of all their words before that and stay out of both steps.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import delete, likely, shared_folder, stored
from bitloom.llm.near_dedup import encoded
from bitloom.llm.rolling import Roller, Words, batches, digests, sliding_min

WINDOW, GRAM = 50, 20
FANOUT = 3
#: Batches, by doc_id, in which a whole table goes into the index.
BATCHES = 4


def fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, digest of all words (w1, w2), their whole SHA-256, distinct window fingerprints."""
    roller = Roller(11)
    for batch in it:
        texts = encoded(batch.column(1))
        for s, e in batches([len(t) for t in texts]):
            w = Words(texts[s:e])
            grams = w.grams(roller, GRAM)
            least = sliding_min(grams, WINDOW - GRAM + 1) if len(grams) > WINDOW - GRAM else grams[:0]
            sha = [hashlib.sha256(b" ".join(t.split())).digest() for t in texts[s:e]]
            whole = np.frombuffer(b"".join([x[:16] for x in sha]), "<i8").reshape(-1, 2)
            marks = [np.unique(least[f : f + n - WINDOW + 1]).view(np.int64) if n >= WINDOW else least[:0].view(np.int64) for f, n in zip(w.first.tolist(), w.counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(s, e - s), pa.array(w.counts, pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]),
                pa.array([x.hex() for x in sha]), pa.array(marks, pa.list_(pa.int64())),
            ], names=["doc_id", "n_words", "w1", "w2", "sha", "marks"])


def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, w1 of the text, start, and digest (h1, h2) of each window whose fingerprint is among `shared`."""
    roller = Roller(11)
    for batch in it:
        texts, shared = encoded(batch.column(1)), batch.column(2)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for s, e in batches([len(t) for t in texts]):
            w = Words(texts[s:e])
            if len(w.starts) < WINDOW:
                continue
            least = sliding_min(w.grams(roller, GRAM), WINDOW - GRAM + 1).view(np.int64)
            whole = digests(b" ".join(t.split()) for t in texts[s:e])[:, 0]
            wanted = [shared[i].values.to_numpy() if shared[i].is_valid else np.zeros(0, np.int64) for i in range(s, e)]
            at = [f + np.flatnonzero(np.isin(least[f : f + n - WINDOW + 1], wanted[i])) if n >= WINDOW else np.zeros(0, np.int64) for i, (f, n) in enumerate(zip(w.first.tolist(), w.counts.tolist(), strict=True))]
            doc = np.repeat(np.arange(e - s), [len(x) for x in at])
            at = np.concatenate(at)
            view = memoryview(w.data)
            sha = digests(view[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at + WINDOW - 1].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[s:e][doc], pa.int64()), pa.array(whole[doc]), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(sha[:, 0]), pa.array(sha[:, 1]),
            ], names=["doc_id", "w1", "start", "h1", "h2"])


def removals(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, w1, n_removed, kept text of texts with the windows at `starts` removed; and w1 of the text meant."""
    for batch in it:
        texts, starts = encoded(batch.column(1)), batch.column(2).to_pylist()
        kept, removed, whole = [], [], []
        for text, at in zip(texts, starts, strict=True):
            words = text.split()
            edge = np.zeros(len(words) + WINDOW + 1, np.int32)
            at = np.array([a for a in at if a + WINDOW <= len(words)], np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            left = np.flatnonzero(np.cumsum(edge)[: len(words)] == 0)
            kept.append(b" ".join([words[i] for i in left.tolist()]).decode())
            removed.append(len(words) - len(left))
            whole.append(int(digests([b" ".join(words)])[0, 0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), batch.column(3)], names=["doc_id", "w1", "n_removed", "kept", "want"])


class FingerprintIndex:
    """Sorted immutable runs of (mark, least and greatest doc_id) in the shared folder. `runs` lists (level, path): keep
    it to go on later. Only the files of runs that a compaction has replaced are deleted."""

    def __init__(self, spark: SparkSession, runs: list[tuple[int, str]] | None = None, buckets: int | None = None):
        self.spark, self.runs = spark, list(runs or [])
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}

    def _write(self, df: DataFrame, level: int) -> str:
        name = f"run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        df.select("mark", "doc", "last").write.bucketBy(self.buckets, "mark").sortBy("mark").option("path", path).saveAsTable(name)
        self.tables[path] = name
        self.runs.append((level, path))
        return path

    def _read(self, path: str) -> DataFrame:
        if path not in self.tables:
            name = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (mark BIGINT, doc BIGINT, last BIGINT) USING parquet CLUSTERED BY (mark) SORTED BY (mark) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.tables[path] = name
        return self.spark.table(self.tables[path])

    def add(self, marks: DataFrame) -> DataFrame:
        """Take in a batch of (mark, doc); mark column of those that now stand in two documents and are in this batch."""
        before = [p for _, p in self.runs]
        ends = marks.groupBy("mark").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
        new = self._read(self._write(ends.repartition(self.buckets, "mark"), 0))
        out = new.where("last > doc").select("mark")
        for path in before:
            old = self._read(path).select("mark", F.col("doc").alias("d"), F.col("last").alias("l"))
            out = out.union(new.hint("merge").join(old, "mark").where("least(doc, d) < greatest(last, l)").select("mark"))
        out = stored(out, "met")
        self.compact()
        return out

    def compact(self) -> None:
        """Merge the runs of each level that has FANOUT of them into one run of the next level, in place of theirs."""
        level = 0
        while level <= max((x for x, _ in self.runs), default=-1):
            full = [p for x, p in self.runs if x == level]
            if len(full) >= FANOUT:
                merged = self._read(full[0])
                for p in full[1:]:
                    merged = merged.union(self._read(p))
                merged = merged.groupBy("mark").agg(F.min("doc").alias("doc"), F.max("last").alias("last"))
                self._write(merged.repartition(self.buckets, "mark"), level + 1)
                self.runs = [r for r in self.runs if r[1] not in full]
                for p in full:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(p)}")
                    delete(self.spark, p)
            level += 1

    def close(self) -> None:
        """Forget the catalogue's names; the runs' files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows (doc_id, n_words, w1, w2, sha, copy), and what is left of those that lose some words by
    windows (doc_id, w1, n_removed, kept)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = stored(docs.mapInArrow(fingerprints, "doc_id long, n_words long, w1 long, w2 long, sha string, marks array<long>"), "sketches")
    long = sk.where(f"doc_id is not null and n_words >= {WINDOW}")
    firsts = stored(long.groupBy("w1", "w2").agg(F.min("doc_id").alias("first")), "firsts")
    own = long.join(firsts, ["w1", "w2"]).where("doc_id = first").select("doc_id", "marks")
    own = stored(own.select(F.col("doc_id").alias("doc"), F.explode("marks").alias("mark")), "marks")
    bounds = own.select(F.percentile_approx("doc", [i / BATCHES for i in range(1, BATCHES)])).first()[0] or []
    index = FingerprintIndex(docs.sparkSession)
    shared = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = own
        part = part if low is None else part.where(F.col("doc") > low)
        part = part if high is None else part.where(F.col("doc") <= high)
        met = index.add(part)
        shared = met if shared is None else shared.union(met)
    index.close()
    # stored, so that joins with hot marks and windows stand on shuffles of their own, which adaptive execution can split
    shared = stored(shared.distinct(), "shared")
    cand = own.join(shared, "mark", "left_semi").groupBy("doc").agg(F.collect_set("mark").alias("shared"))
    cand = stored(cand.withColumnRenamed("doc", "doc_id"), "candidates")
    texts = likely(docs, "doc_id", cand.select("doc_id")).join(cand, "doc_id")
    hashed = texts.select("doc_id", "text", "shared").mapInArrow(windows, "doc_id long, w1 long, start int, h1 long, h2 long")
    hashed = stored(hashed, "windows")
    least = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    gone = hashed.join(stored(least, "least"), ["h1", "h2"]).where("doc_id > least").select("doc_id", "w1", "start")
    gone = stored(gone.groupBy("doc_id", "w1").agg(F.collect_set("start").alias("starts")), "removals")
    again = likely(docs, "doc_id", gone.select("doc_id")).join(gone.select("doc_id", "starts", F.col("w1").alias("want")), "doc_id")
    left = again.select("doc_id", "text", "starts", "want").mapInArrow(removals, "doc_id long, w1 long, n_removed long, kept string, want long")
    return sk.join(firsts, ["w1", "w2"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first", "marks"), left.where("w1 = want").drop("want").dropDuplicates(["doc_id", "w1"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs (doc_id, text).

    Words are runs of other than ASCII white space. A word is removed if a 50-word window over it also starts in a
    document of smaller doc_id, as the input stands. Null texts and those below 50 words lose nothing; rows with a null
    doc_id lose nothing and take nothing from others; rows of one doc_id take nothing from each other; repeated rows get
    the same result each; an empty table gives no rows. A doc_id that is a text of a whole number counts as that number.
    Very long texts are taken whole, one at a time. Other columns are not read.
    """
    sk, left = removed(docs)
    out = sk.join(left.select("doc_id", "w1", F.col("n_removed").alias("r"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("k")), ["doc_id", "w1"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"), F.when(F.col("copy"), empty).otherwise(F.coalesce("k", "sha")).alias("kept_sha256"))
