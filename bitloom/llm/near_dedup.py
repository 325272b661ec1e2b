"""MinHash near-dedup by a multi-index Hamming join.

1. Sketch: a document's distinct 5-word shingles give a signature of 60 minimum hashes cut to 16 bits each.
2. Multi-index: the signature is split into 15 chunks of 4 symbols. If two signatures differ in at most 29 symbols,
   some chunk has at most one error (pigeonhole). Each chunk is posted under its 4 allowed errors (one symbol
   masked), so all such pairs meet in a bucket, and with them every pair within the threshold FAR.
3. Buckets: members are compared on whole signatures. In a bucket of more than 256 each first meets the bucket's head;
   those near it are one tree already, so only the others are compared with all, in blocks of 256 so that no task gets
   a whole hot bucket. Only a spanning forest of a task's pairs within FAR symbols goes on: never all pairs.
4. Confirm, on the words themselves: each document meets its least and its greatest neighbour in that forest, one row
   with two texts each. Documents that these true links join are one from here on. Only where a candidate cluster still
   falls into several parts are the parts' documents compared with each other, again in blocks; two documents of a large
   cluster's greatest part are not. Components of the true links are the result.

Documents with the same words (SHA-256 of them, ASCII letters lower-cased) are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import Forest, components, in_batches, likely, stored, whole_groups, without
from bitloom.llm.rolling import Roller, Words, batches, digests, mix, stream

SHINGLE = 5
SYMBOLS, CHUNK = 60, 4
#: Signature distance within which a pair is confirmed on full sets; at similarity 0.8 a farther pair is one in 10**6.
FAR = 27
BLOCK = 256
U = np.uint64


def shingle_sets(texts: list[bytes], roller: Roller) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: its 5-word runs, or all of fewer words as one."""
    low = [t.lower() for t in texts]
    for s, e in batches([len(t) for t in low]):
        w = Words(low[s:e])
        prefix = roller.prefix(w.data)
        grams, whole = w.grams(roller, SHINGLE, prefix), w.whole(roller, prefix)
        for i in range(e - s):
            n, f = int(w.counts[i]), int(w.first[i])
            yield np.unique(grams[f : f + n - SHINGLE + 1]) if n >= SHINGLE else whole[i : i + (n > 0)]


def encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sketch_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roller = Roller(5)
    with np.errstate(over="ignore"):
        odd = stream(6, SYMBOLS) | U(1)
        places = stream(7, SYMBOLS)
        for batch in it:
            texts = encoded(batch.column(1))
            for s, e in batches([len(t) for t in texts]):
                sets = list(shingle_sets(texts[s:e], roller))
                sizes = np.array([len(x) for x in sets])
                has = sizes > 0
                every = np.concatenate([*sets, np.zeros(0, U)])
                at = (np.cumsum(sizes) - sizes)[has]
                n = int(has.sum())
                sig = np.zeros((n, SYMBOLS), np.uint16)
                if n:
                    for j in range(SYMBOLS):
                        sig[:, j] = (mix(np.minimum.reduceat(every * odd[j], at)) >> U(48)).astype(np.uint16)
                same = digests(b" ".join(t.lower().split()) for t in texts[s:e])
                # a chunk's key under one error: the sum over its other symbols, told apart by chunk and masked place
                value = mix(sig.astype(U) + places[None, :])
                chunk = value.reshape(n, -1, CHUNK).sum(axis=2, dtype=U)
                keys = mix(np.repeat(chunk, CHUNK, axis=1) - value + places[None, :])
                rows = iter(range(n))
                which = [next(rows) if h else None for h in has]
                pick = lambda values: [None if r is None else values[r] for r in which]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(s, e - s), pa.array(sizes, pa.int64()),
                    pa.array(same[:, 0], mask=~has), pa.array(same[:, 1], mask=~has),
                    pa.array([None if r is None else sig[r].tobytes() for r in which], pa.binary()),
                    pa.array([None if r is None else keys[r].view(np.int64) for r in which], pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "same1", "same2", "sig", "keys"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the words' 128-bit digest, signature and bucket keys of every document."""
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sketch_batches, "doc_id long, n_shingles long, same1 long, same2 long, sig binary, keys array<long>")


def bucket_edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all block pairs of buckets in a task: a spanning forest of the pairs within FAR, so fewer than it has ids."""
    trees = Forest()
    for t, offsets in whole_groups(it, ["key", "x", "y"]):
        ids, block = t.column("id").to_numpy(), t.column("block").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        found = []
        sizes = np.diff(offsets)
        two = offsets[:-1][sizes == 2]
        near = two[((sig[two] != sig[two + 1]).sum(axis=1) <= FAR)]
        found += [p for p in zip(ids[near].tolist(), ids[near + 1].tolist(), strict=True) if trees.joins(*p)]
        for s, e in zip(offsets[:-1][sizes > 2].tolist(), offsets[1:][sizes > 2].tolist(), strict=True):
            one, other = np.flatnonzero(block[s:e] == x[s]), np.flatnonzero(block[s:e] == y[s])
            for i in one.tolist():
                beyond = other[other > i] if x[s] == y[s] else other
                hit = beyond[(sig[s:e][beyond] != sig[s + i]).sum(axis=1) <= FAR]
                found += [p for p in ((int(ids[s + i]), j) for j in ids[s + hit].tolist()) if trees.joins(*p)]
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def words_of(text: bytes | None) -> tuple[set, int]:
    """The exact 5-word shingles of a text, as tuples of words, and their number."""
    w = (text or b"").lower().split()
    out = set(zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else {tuple(w)} if w else set()
    return out, len(out)


def true_pairs(percent: int):
    """Of rows (a, one, b, other), two ids and their texts: the ids whose sets meet 100 * intersection >= percent * union."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, tuple] = (None, words_of(None))
        for batch in it:
            keep = []
            for one, other in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                # neighbours that many rows share stand together
                last = last if last[0] == other else (other, words_of(other))
                (x, n), (y, m) = words_of(one), last[1]
                both = len(x & y) if 100 * min(n, m) >= percent * max(n, m) else 0
                keep.append(100 * both >= percent * (n + m - both) and both > 0)
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    return run


def true_links(sets: list[set], one: list[int], other: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of one x other whose sets meet 100 * intersection >= percent * union, as a product of 0/1 matrices."""
    which = [*one, *other]
    number: dict = {}
    times: list[int] = []
    col = []
    for i in which:
        for shingle in sets[i]:
            j = number.setdefault(shingle, len(times))
            if j == len(times):
                times.append(0)
            times[j] += 1
            col.append(j)
    size = np.array([len(sets[i]) for i in which])
    row, col = np.repeat(np.arange(len(which)), size), np.array(col, np.int64)
    keep = np.array(times)[col] > 1 if len(col) else np.zeros(0, bool)
    row, col = row[keep], np.unique(col[keep], return_inverse=True)[1]
    shared = np.zeros((len(one), len(other)), np.float32)
    width = int(col.max()) + 1 if len(col) else 0
    for lo in range(0, width, 8192):
        part = (col >= lo) & (col < lo + 8192)
        m = np.zeros((len(which), min(8192, width - lo)), np.float32)
        m[row[part], col[part] - lo] = 1
        shared += m[: len(one)] @ m[len(one) :].T
    inter = np.rint(shared).astype(np.int64)
    union = size[: len(one), None] + size[None, len(one) :] - inter
    for i, j in zip(*np.nonzero((100 * inter >= percent * union) & (inter > 0)), strict=True):
        yield one[i], other[j]


def confirmed(percent: int):
    """Of block pairs of clusters (cluster, x, y, block, id, part, text): a spanning forest of the true links."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for t, offsets in whole_groups(it, ["cluster", "x", "y"]):
            a, b = [], []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                g = t.slice(s, e - s)
                ids, part, block = g.column("id").to_pylist(), g.column("part").to_pylist(), g.column("block").to_numpy()
                x, y = g.column("x")[0].as_py(), g.column("y")[0].as_py()
                one, other = np.flatnonzero(block == x).tolist(), np.flatnonzero(block == y).tolist()
                if not one or not other or len({part[i] for i in (*one, *other)}) == 1:
                    continue
                for i, p in zip(ids, part, strict=True):
                    trees.joins(i, p)
                sets = [words_of(x)[0] for x in encoded(g.column("text"))]
                for i, j in true_links(sets, one, other, percent):
                    if trees.joins(ids[i], ids[j]):
                        a.append(ids[i])
                        b.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def block_pairs(df: DataFrame, group: str) -> DataFrame:
    """Deal the members of each group (group, id, members, main) out to pairs (x, y) of blocks of about BLOCK members;
    x = y within a block.

    Members marked `main` are in one tree already and have blocks of their own: those meet the other members' blocks only,
    so a group with few others makes rows in proportion to its members. Groups of up to BLOCK have no main members.
    """
    few = df.where(F.col("members") <= BLOCK).withColumns({n: F.lit(0) for n in ("block", "x", "y")})
    many = df.where(F.col("members") > BLOCK)
    blocks = lambda which: F.ceil(F.count_if(which) / BLOCK).cast("int")
    sizes = many.groupBy(group).agg(blocks(~F.col("main")).alias("others"), blocks(F.col("main")).alias("mains"))
    spread = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(n, F.lit(1))).cast("int")
    many = many.join(sizes, group).withColumn("block", F.when(F.col("main"), F.col("others") + spread(F.col("mains"))).otherwise(spread(F.col("others"))))
    many = many.withColumn("last", F.col("others") - 1 + F.when(F.col("main"), 0).otherwise(F.col("mains"))).where("last >= 0")
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    many = many.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    return few.unionByName(many.select(*few.columns))


def near_head(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id, members, head, sig, head_sig): the first four and whether the signatures lie within FAR."""
    for batch in it:
        one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sig", "head_sig"))
        main = pa.array((one != other).sum(axis=1) <= FAR)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], main], names=["key", "id", "members", "head", "main"])


def stars(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """key, id, members, head, main for the members of buckets of more than BLOCK: whether each is near its bucket's head."""
    many = members.where(F.col("members") > BLOCK)
    heads = many.groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(5))).alias("head"))
    heads = heads.join(sigs.select(F.col("id").alias("head"), F.col("sig").alias("head_sig")), "head")
    rows = many.join(heads, "key").join(sigs, "id").select("key", "id", "members", "head", "sig", "head_sig")
    return in_batches(rows, near_head, "key long, id long, members long, head long, main boolean")


def dealt(df: DataFrame, group: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "x", "y").sortWithinPartitions(group, "x", "y")


def cluster(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    Links join documents whose sets of distinct 5-word shingles (ASCII letters lower-cased) meet
    100 * intersection >= percent * union; component_id is the least doc_id reachable by links, kept marks that document.
    Null or wordless texts have no shingles, link with nothing and are kept. Rows with a null doc_id stay, with a null
    component_id, and are kept; rows of one doc_id stay, one node together that links by any of their texts. An empty
    table gives no rows. Very long texts are taken whole, one at a time. A doc_id must be a whole number. Other columns
    are not read.
    """
    sk = stored(sketches(docs), "sketches")
    reps = stored(sk.where("n_shingles > 0 and doc_id is not null").groupBy("same1", "same2").agg(F.min("doc_id").alias("rep")), "reps")
    nodes = sk.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "same1", "same2"])
    posted = nodes.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    many = posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = stored(posted.join(many, "key"), "members")
    sigs = nodes.select(F.col("doc_id").alias("id"), "sig")
    star = stored(stars(members, sigs), "stars")
    small = members.where(F.col("members") <= BLOCK).select("key", "id", "members", F.lit(False).alias("main"))
    pairs = block_pairs(small.unionByName(star.drop("head")), "key").join(sigs, "id")
    edges = in_batches(dealt(pairs.select("key", "x", "y", "block", "id", "sig"), "key"), bucket_edges, "a long, b long")
    near = stored(edges.union(star.where("main and id <> head").select("head", "id")).distinct(), "near")
    clusters = stored(components(near).select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
    # texts of the candidates alone, all of those that stand under one doc_id
    texts = likely(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", clusters.select("id")).join(clusters, "id").dropDuplicates(["id", "text"])
    texts = stored(texts, "texts")
    ends = near.select("a", "b").union(near.select("b", "a"))
    neighbours = ends.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"))
    met = neighbours.select("a", F.explode(F.array_distinct(F.array("least", "most"))).alias("b"))
    rows = met.join(texts.select(F.col("id").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
    first = stored(in_batches(rows.select("a", "one", "b", "other"), true_pairs(percent), "a long, b long").distinct(), "first")
    parts = components(first).withColumnRenamed("node", "id").withColumnRenamed("component", "part")
    parts = stored(clusters.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "parts")
    # clusters of two have been compared whole
    sizes = parts.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("cluster").agg(F.sum("n").alias("members"), F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("greatest")).where("parts > 1 and members > 2")
    rest = texts.join(parts.drop("cluster"), "id").join(open_, "cluster").withColumn("main", (F.col("members") > BLOCK) & (F.col("part") == F.col("greatest")))
    links = in_batches(dealt(block_pairs(rest.select("cluster", "id", "part", "text", "members", "main"), "cluster").select("cluster", "x", "y", "block", "id", "part", "text"), "cluster"), confirmed(percent), "a long, b long")
    found = components(first.select("a", "b").union(links))
    whole = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("same1", "same2", F.coalesce("component", "rep").alias("c"))
    out = sk.select("doc_id", "n_shingles", "same1", "same2").join(whole, ["same1", "same2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that stay when each group of near copies keeps its least doc_id, with docs' own columns.

    Rows with a null doc_id stay, and so do those without words; of rows that share a doc_id all go or all stay. An empty
    table gives no rows.
    """
    dropped = stored(cluster(docs, percent).where("not kept").select("doc_id"), "dropped")
    return without(docs, "doc_id", dropped)
