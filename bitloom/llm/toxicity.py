"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon (words, and beginnings of words, that mark label 1), hits near a
second-person pronoun, capitals, punctuation and obfuscation (hits that show only once look-alike signs are read as
letters or signs inside a word are dropped). The lexicon, the trees and the calibration are learned in numpy on the
driver from a bounded sample of labelled rows. The lexicon that makes a row's training features comes from the other
half of the sample, and so do the predictions that the calibration fits, so neither has seen the row's own label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import held_out
from bitloom.llm.near_dedup import encoded
from bitloom.llm.rolling import Roller, Words, batches
from bitloom.llm.sampling import labelled

U = np.uint64
#: Second-person words of the languages at hand.
SECOND_PERSON = ["du", "dein", "deine", "dich", "dir", "ihr", "sie", "su", "te", "tes", "ti", "toi", "ton", "tu", "tus", "u", "usted", "vos", "votre", "vous", "you", "your", "yours"]
#: Signs that stand for letters in disguised words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
BEGINNINGS = (4, 5, 6)
#: A lexicon entry stands in at least SUPPORT distinct texts of label 1, and is RATIO times as frequent there.
SUPPORT, RATIO = 3, 12.0
NEAR_WORDS = 5
TREES, DEPTH, SHRINK, BINS, LEAST = 60, 3, 0.2, 32, 8

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_plain = _low.copy()
for _sign, _for in LOOKALIKES.items():
    _plain[ord(_sign)] = ord(_for)
_sign = np.zeros(256, bool)
_sign[[ord(c) for c in LOOKALIKES]] = True
_between = np.zeros(256, bool)
_between[[ord(c) for c in "*-._"]] = True
_kinds = {k: np.array([f(chr(b)) if b < 128 else False for b in range(256)]) for k, f in (("upper", str.isupper), ("digit", str.isdigit), ("loud", lambda c: c in "!?"), ("punct", lambda c: 32 < ord(c) < 127 and not c.isalnum()))}


def runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], on.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Tokens:
    """Lower-cased letter runs of a batch of texts and their hashes; `doc` is the text of each."""

    def __init__(self, texts: list[bytes], roller: Roller):
        self.words, self.roller = Words(texts), roller
        raw = self.words.data
        sizes = np.zeros(len(texts), np.int64)
        has = self.words.counts > 0
        first, n = self.words.first[has], self.words.counts[has]
        self.begin, self.end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        self.begin[has], self.end[has] = self.words.starts[first], self.words.ends[first + n - 1]
        sizes[has] = self.end[has] - self.begin[has]
        self.sizes = sizes
        self.letters = _letter[raw]
        self.low = _low[raw]
        self.prefix = roller.prefix(self.low)
        self.starts, self.ends = runs(self.letters)
        self.hash = roller.ranges(self.prefix, self.starts, self.ends)
        self.doc = self.of(self.starts)

    def of(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        full = np.flatnonzero(self.sizes > 0)
        return full[np.searchsorted(self.begin[full], at, side="right") - 1] if len(full) else np.zeros(0, np.int64)

    def beginning(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which letter runs are longer than size bytes, and the hash of their first ones."""
        long = np.flatnonzero(self.ends - self.starts > size)
        return long, self.roller.ranges(self.prefix, self.starts[long], self.starts[long] + size) ^ U(size)

    def disguised(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts and hashes of words as read without their disguise."""
        raw = self.words.data
        on = self.letters | _sign[raw]
        starts, ends = runs(on)
        plain = np.concatenate([[0], np.cumsum(self.letters)])
        mixed = (plain[ends] - plain[starts] < ends - starts) & (plain[ends] > plain[starts])
        starts, ends = starts[mixed], ends[mixed]
        yield self.of(starts), self.roller.ranges(self.roller.prefix(_plain[raw]), starts, ends)
        drop = np.zeros(len(raw), bool)
        drop[1:-1] = _between[raw[1:-1]] & self.letters[:-2] & self.letters[2:]
        if drop.any():
            keep = np.flatnonzero(~drop)
            starts, ends = runs(self.letters[keep])
            grown = keep[ends - 1] - keep[starts] > ends - 1 - starts
            starts, ends = starts[grown], ends[grown]
            yield self.of(keep[starts]), self.roller.ranges(self.roller.prefix(self.low[keep]), starts, ends)


@dataclass
class Lexicon:
    words: np.ndarray
    beginnings: np.ndarray
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        self.table = np.zeros((2, 1 << 16), bool)
        for i, x in enumerate((self.words, self.beginnings)):
            self.table[i, x >> U(48)] = True

    def hits(self, hashes: np.ndarray, which: int = 0) -> np.ndarray:
        out = self.table[which, hashes >> U(48)]
        at = np.flatnonzero(out)
        out[at] = np.isin(hashes[at], (self.words, self.beginnings)[which])
        return out


def learn_lexicon(texts: list[bytes], y: np.ndarray) -> Lexicon:
    roller = Roller(4)
    seen: tuple[list[Counter], list[Counter]] = ([Counter(), Counter()], [Counter(), Counter()])
    n = [1, 1]
    for text, label in {t: int(v) for t, v in zip(texts, y, strict=True)}.items():
        t = Tokens([text], roller)
        n[label] += 1
        seen[0][label].update(np.unique(t.hash).tolist())
        seen[1][label].update(np.unique(np.concatenate([t.beginning(k)[1] for k in BEGINNINGS])).tolist())
    out = []
    for no, yes in seen:
        keep = [w for w, c in yes.items() if c >= SUPPORT and (c + 0.5) / n[1] > RATIO * (no[w] + 0.5) / n[0]]
        out.append(np.array(sorted(keep), U))
    return Lexicon(*out)


FEATURES = ["words", "lexicon", "lexicon_n", "begin", "begin_n", "disguised", "second_person", "upper", "digit", "loud", "punct", "shouted", "signs_inside", "non_ascii", "word_bytes"]


def dense(texts: list[bytes], lexicon: Lexicon, roller: Roller) -> np.ndarray:
    """The features of each text of one batch."""
    t = Tokens(texts, roller)
    n, out = len(texts), np.zeros((len(texts), len(FEATURES)))
    count = lambda doc: np.bincount(doc, minlength=n).astype(float)
    words, size = np.maximum(t.words.counts, 1).astype(float), np.maximum(t.sizes, 1).astype(float)
    hit = lexicon.hits(t.hash)
    begun = np.zeros(len(t.hash), bool)
    for k in BEGINNINGS:
        long, h = t.beginning(k)
        begun[long[lexicon.hits(h, 1)]] = True
    any_hit = hit | begun
    hidden = sum((count(doc[lexicon.hits(h)]) for doc, h in t.disguised()), np.zeros(n))
    person = np.array([int(Words([w.encode()]).grams(roller, 1)[0]) for w in SECOND_PERSON], U)
    you = np.flatnonzero(np.isin(t.hash, person))
    close = np.zeros(len(t.hash), bool)
    if len(you):
        at = np.flatnonzero(any_hit)
        where = np.searchsorted(you, at)
        for near in (you[np.minimum(where, len(you) - 1)], you[np.maximum(where - 1, 0)]):
            close[at] |= (np.abs(near - at) <= NEAR_WORDS) & (t.doc[near] == t.doc[at])
    out[:, 0] = np.log1p(t.words.counts)
    out[:, 1], out[:, 2] = 100 * count(t.doc[hit]) / words, np.log1p(count(t.doc[hit]))
    out[:, 3], out[:, 4] = 100 * count(t.doc[begun]) / words, np.log1p(count(t.doc[begun]))
    out[:, 5], out[:, 6] = np.log1p(hidden), np.log1p(count(t.doc[close]))
    raw = t.words.data
    total = lambda on: (c := np.concatenate([[0], np.cumsum(on)]))[t.end] - c[t.begin]
    for i, k in enumerate(("upper", "digit", "loud", "punct")):
        out[:, 7 + i] = total(_kinds[k][raw]) / size
    inside = np.zeros(len(raw), bool)
    inside[1:-1] = ~t.letters[1:-1] & t.letters[:-2] & t.letters[2:] & (raw[1:-1] != 32)
    up = np.concatenate([[0], np.cumsum(_kinds["upper"][raw])])
    shouted = (up[t.ends] - up[t.starts] == t.ends - t.starts) & (t.ends - t.starts > 1)
    out[:, 11], out[:, 12] = count(t.doc[shouted]) / words, total(inside) / words
    out[:, 13], out[:, 14] = total(raw > 127) / size, size / words
    return out


def all_dense(texts: list[bytes], lexicon: Lexicon, roller: Roller) -> np.ndarray:
    parts = [dense(texts[s:e], lexicon, roller) for s, e in batches([len(t) for t in texts])]
    return np.concatenate([np.zeros((0, len(FEATURES))), *parts])


@dataclass
class Trees:
    """Boosted trees of one depth: `feature` and `cut` of each inner node in level order, `leaf` values; and the base."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(cut)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # rare positive values of mostly-zero features need cuts of their own
    for j in range(x.shape[1]):
        above = x[x[:, j] > 0, j]
        if len(above):
            cuts[j] = np.unique(np.concatenate([cuts[j], [0.0], np.quantile(above, np.linspace(0, 1, BINS // 2)[:-1])]))
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), base)
    inner = 2**DEPTH - 1
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for k in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for v in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == v)
                best = (1e-6, 0, np.inf)
                for j in range(x.shape[1]) if len(rows) >= 2 * LEAST else ():
                    b = bins[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, weights=q, minlength=width))[:-1] for q in (g[rows], h[rows], np.ones(len(rows))))
                    G, H = g[rows].sum(), h[rows].sum()
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                    i = int(gain[: len(cuts[j])].argmax()) if len(cuts[j]) else 0
                    if len(cuts[j]) and gain[i] > best[0]:
                        best = (gain[i], j, cuts[j][i])
                feature[k, v], cut[k, v] = best[1], best[2]
                node[rows] = 2 * v + 1 + (x[rows, best[1]] > best[2])
        at = node - inner
        leaf[k] = -SHRINK * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + 1)
        margin += leaf[k][at]
    return Trees(base, feature, cut, leaf)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean margins of the blocks and their rates of label 1, both rising."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, m, 1.0])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][2] >= blocks[-1][0] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 1] / b[:, 2], b[:, 0] / b[:, 2]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    rate: np.ndarray

    def scores(self, texts: list[bytes], roller: Roller) -> np.ndarray:
        """Calibrated probability of label 1; a hundredth of it follows the margin, which orders equal rates."""
        margin = self.trees.margins(dense(texts, self.lexicon, roller))
        return 0.99 * np.interp(margin, self.at, self.rate) + 0.01 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(sample: pd.DataFrame) -> Model:
    """Fit on text and y. With one label only, or no rows, the score is a constant."""
    texts, y = sample["text"].tolist(), (sample["y"].to_numpy() > 0).astype(float)
    roller = Roller(4)
    half = np.array([sum(t) % 2 for t in texts], bool) if texts else np.zeros(0, bool)
    x = np.zeros((len(y), len(FEATURES)))
    if len(set(y.tolist())) < 2 or not 0 < half.sum() < len(half):
        empty = Lexicon(np.zeros(0, U), np.zeros(0, U))
        rate = float(y.mean()) if len(y) else 0.5
        return Model(empty, Trees(0.0, *(np.zeros((0, 2**DEPTH - 1), k) for k in (np.int64, float)), np.zeros((0, 2**DEPTH))), np.array([0.0]), np.array([rate]))
    for side in (half, ~half):
        other = learn_lexicon([t for t, s in zip(texts, side, strict=True) if not s], y[~side])
        x[side] = all_dense([t for t, s in zip(texts, side, strict=True) if s], other, roller)
    margin = np.zeros(len(y))
    for side in (half, ~half):
        margin[side] = boost(x[~side], y[~side]).margins(x[side])
    return Model(learn_lexicon(texts, y), boost(x, y), *isotonic(margin, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with a text column) and `score`, in one pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(4)
        for batch in it:
            texts = encoded(batch.column(batch.schema.get_field_index("text")))
            got = [shared.value.scores(texts[s:e], roller) for s, e in batches([len(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*got, np.zeros(0)]))], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text).

    Null and wordless texts are scored by features of zero; a null doc_id is not held out; an empty table gives no
    rows; repeated rows are scored alike; without usable labels every score is near 0.5. Other columns are not read.
    """
    out = scored(docs.select("doc_id", "text"), train(labelled(docs, labels, "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
