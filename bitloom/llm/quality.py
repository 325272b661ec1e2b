"""Quality classifier with supervised subword embeddings.

Words, character 3- and 4-grams, n-grams of character classes and the relation of a word to the words before it are
hashed to buckets, each with a learned vector. A document is the mean of its vectors and a softmax layer reads that
mean. Vectors and layer are trained together by stochastic gradient descent in numpy on the driver, over a bounded
sample of labelled rows. Scoring is linear in the mean, so executors need one number for each bucket: the product of
its vector and the layer, a table of fixed size whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import fresh, held_out, in_batches
from bitloom.llm.near_dedup import encoded
from bitloom.llm.rolling import Roller, Words, batches
from bitloom.llm.sampling import labelled

BITS = 16
BUCKETS = 1 << BITS
DIM, EPOCHS, RATE, BATCH = 8, 6, 0.05, 32
#: A document is kept at this score or more.
KEEP = 0.3


def classes() -> np.ndarray:
    """Byte to character class: other, space, lower, upper, digit, each further ASCII sign its own, non-ASCII."""
    out = np.zeros(256, np.uint32)
    for b in range(33, 127):
        c = chr(b)
        out[b] = 2 if c.islower() else 3 if c.isupper() else 4 if c.isdigit() else b
    out[32], out[128:] = 1, 2
    return out


CLASS = classes()


def hashed(parts: list[np.ndarray], family: int) -> np.ndarray:
    h = np.full(len(parts[-1]), family * 2654435761 & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p[: len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def features(texts: list[bytes], roller: Roller) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: buckets, and where each text's begin and end. Texts are those of one batch; no feature reaches
    beyond its text and the space behind it."""
    w = Words(texts)
    data, n = w.data.astype(np.uint32), len(w.data)
    has = w.counts > 0
    begin, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    begin[has] = w.starts[w.first[has]]
    end[has] = w.ends[(w.first + w.counts)[has] - 1] + 1
    shape = CLASS[w.data]
    for family, x, size in ((1, data, 3), (2, data, 4), (3, shape, 3)):
        if n >= size:
            yield hashed([x[i : n - size + 1 + i] for i in range(size)], family), begin, np.maximum(begin, end - size + 1)
    word = np.zeros(0, np.uint64)
    if len(w.starts):
        word = roller.ranges(roller.prefix(w.data), w.starts, w.ends)
    first, last = w.first, w.first + w.counts
    yield (word >> np.uint64(64 - BITS)).astype(np.uint32), first, last
    same, nth = np.zeros(len(word), np.uint32), np.arange(len(word)) - np.repeat(first, w.counts)
    for back in (1, 2, 3):
        same[back:] |= ((word[back:] == word[: len(word) - back]) & (nth[back:] >= back)).astype(np.uint32) << np.uint32(back)
    yield hashed([same], 5), first, last


def sums(value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return total[end] - total[begin]


@dataclass
class Model:
    weight: np.ndarray  # one number for each bucket
    bias: float

    def scores(self, texts: list[bytes], roller: Roller) -> np.ndarray:
        """Probability of label 1; each family of features has the same share of the mean."""
        total = np.zeros(len(texts))
        for bucket, begin, end in features(texts, roller):
            total += sums(self.weight[bucket], begin, end) / np.maximum(end - begin, 1)
        return np.round(1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30))), 9)


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and their shares of all texts, one after another, and the place where each begins (one more at the end).

    The shares of a text sum to 1 in each family. A few large arrays, which the driver gives back when it is done.
    """
    roller, at, share, sizes = Roller(2), [], [], [0]
    for t in texts:
        bag = np.zeros(BUCKETS, np.float32)
        for bucket, (begin,), (end,) in features([t], roller):
            if n := int(end - begin):
                bag += np.bincount(bucket[begin:end], minlength=BUCKETS).astype(np.float32) / n
        used = np.flatnonzero(bag)
        at.append(used.astype(np.uint16))
        share.append(bag[used])
        sizes.append(len(used))
    return np.concatenate(at), np.concatenate(share), np.cumsum(sizes)


def train(sample: pd.DataFrame, seed: int = 0) -> Model:
    """Fit on text and y. With one label only, or no rows, the score is a constant."""
    y = sample["y"].to_numpy() > 0
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(BUCKETS, np.float32), 3.0 if len(y) and y.all() else -3.0 if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    vector = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    layer = (rng.random((DIM, 2), np.float32) - 0.5) / DIM
    bias = np.zeros(2, np.float32)
    buckets, shares, begins = bags(sample["text"].tolist())
    goal = np.stack([~y, y], axis=1).astype(np.float32)
    epochs = min(60, max(EPOCHS, EPOCHS * 2000 // len(y)))
    seen, seen_layer, seen_bias = (np.full(x.shape, 1e-8, np.float32) for x in (vector, layer, bias))

    def descend(x: np.ndarray, past: np.ndarray, gradient: np.ndarray, at=...) -> None:
        """A step whose rate falls with the squared gradients so far (AdaGrad), for sparse buckets learn as fast."""
        past[at] += gradient * gradient
        x[at] -= RATE * gradient / np.sqrt(past[at])

    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            rows = order[s : s + BATCH]
            at = np.concatenate([buckets[begins[r] : begins[r + 1]] for r in rows])
            share = np.concatenate([shares[begins[r] : begins[r + 1]] for r in rows])
            sizes = begins[rows + 1] - begins[rows]
            begin = np.cumsum(sizes) - sizes
            used = sizes > 0
            hidden = np.zeros((len(rows), DIM), np.float32)
            if used.any():
                hidden[used] = np.add.reduceat(vector[at] * share[:, None], begin[used], axis=0)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - goal[rows]) / len(rows)
            back = error @ layer.T
            descend(layer, seen_layer, hidden.T @ error)
            descend(bias, seen_bias, error.sum(axis=0))
            where, inverse = np.unique(at, return_inverse=True)
            weighted = np.repeat(back, sizes, axis=0) * share[:, None]
            gradient = np.stack([np.bincount(inverse, weights=weighted[:, d], minlength=len(where)) for d in range(DIM)], axis=1)
            descend(vector, seen, gradient.astype(np.float32), where)
    difference = layer[:, 1] - layer[:, 0]
    return Model((vector @ difference).astype(np.float32), float(bias[1] - bias[0]))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column `name` of scores, in one pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(2)
        for batch in it:
            texts = encoded(batch.column(batch.schema.get_field_index("text")))
            got = [shared.value.scores(texts[s:e], roller) for s, e in batches([len(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*got, np.zeros(0)]))], names=[f.name for f in schema])

    return in_batches(docs, run, schema)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled(docs, labels, "quality"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is KEEP or more, with docs' own columns; a column `score` of docs is left alone."""
    name = fresh(docs, "score")
    return scored(docs, learn(docs, labels), name).where(F.col(name) >= KEEP).drop(name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text).

    Null and wordless texts get the score of the bias alone; a null doc_id is not held out; an empty table gives no
    rows; repeated rows are scored alike; without usable labels every score is 0.5. Other columns are not read.
    """
    out = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
