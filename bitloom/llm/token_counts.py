"""Exact token counts of whole texts, with huge documents encoded in overlapping chunks.

A long document is cut into chunks that overlap. Each chunk is encoded by the library alone and its pieces laid out
with offsets. Two neighbours are spliced at a position in their overlap where both have a piece boundary and which is
proven stable: no piece of the vocabulary holds the two characters at it side by side, so no merge ever crosses it,
whatever stands around it. Such a place needs no space; texts in scripts without spaces have them too. Where an overlap
holds none, or the pieces don't meet there, it is widened, and then the chunk. Only a text without any stable place, such
as one letter repeated, is encoded in one piece.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGN = "▁"
#: Characters from which a document is encoded in chunks, those of a chunk, and of the first overlap tried.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256


def left_alone(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether the model leaves a text itself as it is."""
    probe = "Ａ  x é"
    return model.decode(model.encode(probe)) == probe


def neighbours(model: sentencepiece.SentencePieceProcessor) -> frozenset[str]:
    """All pairs of characters that stand side by side in some piece of the vocabulary."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    return frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))


def laid_out(model: sentencepiece.SentencePieceProcessor, chunk: str) -> list[int] | None:
    """Ends of the chunk's pieces, as byte offsets in the chunk with a space sign before it; None if they don't fit."""
    sizes = [1 if model.is_byte(i) else len(model.id_to_piece(i).encode()) for i in model.encode(chunk)]
    ends = list(accumulate(sizes))
    whole = len((SIGN + chunk.replace(" ", SIGN)).encode())
    return ends if ends and ends[-1] == whole else None


def splice(model: sentencepiece.SentencePieceProcessor, text: str, joined: frozenset[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of a huge text, from its chunks; `joined` are the vocabulary's neighbours()."""
    text = text.replace(" ", SIGN)
    total, start, skip = 0, 0, 0  # skip: pieces of this chunk that the one before has counted
    ready: dict[tuple[int, int], list[int] | None] = {}

    def ends_of(begin: int, end: int) -> list[int] | None:
        if (begin, end) not in ready:
            ready.clear()
            ready[begin, end] = laid_out(model, text[begin:end])
        return ready[begin, end]

    def count(begin: int, end: int, at: int) -> int | None:
        """Pieces of a chunk before a place, if one ends there."""
        ends, here = ends_of(begin, end), len((SIGN + text[begin:at]).encode())
        i = -1 if ends is None else bisect_left(ends, here)
        return i + 1 if ends is not None and i < len(ends) and ends[i] == here else None

    while True:
        end, width = min(len(text), start + chunk), overlap
        while end < len(text):
            # the next chunk begins `width` before this one's end; find the last stable place well inside both
            low, high = end - width, end - width // 8
            at = next((i for i in range(high, low + width // 8, -1) if text[i - 1 : i + 1] not in joined), None)
            if at is not None and (mine := count(start, end, at)) is not None and (there := count(low, min(len(text), low + chunk), at)) is not None:
                break
            width *= 2
            if width >= chunk:
                end, width = min(len(text), end + chunk), overlap
        if end >= len(text):
            ends = ends_of(start, end)
            return len(model.encode(text)) if ends is None else total + len(ends) - skip
        total += mine - skip
        start, skip = low, there


def counter(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, joined = left_alone(model), neighbours(model)
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            known: dict[str, int] = {}
            for t in texts:
                if t not in known:
                    known[t] = splice(model, t, joined) if plain and len(t) >= HUGE else len(model.encode(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([known[t] for t in texts], np.int64))], names=["doc_id", "n_tokens"])

    return run


def counted(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text), by the model file at `path`.

    Null and empty texts have no bytes and no tokens; null ids and repeated rows stay; an empty table gives no rows. Very
    long texts are counted whole, chunk by chunk.
    Other columns are not read.
    """
    size = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    cols = docs.select(F.struct("doc_id", size.alias("n_bytes")).alias("doc_id"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    out = cols.mapInArrow(counter(path), f"doc_id struct<doc_id: {kind}, n_bytes: long>, n_tokens long")
    return out.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
