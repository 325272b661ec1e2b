"""The bounded sample of labelled rows that the two classifiers learn from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import held_out

#: At most so many labelled rows are learned from; every other computation covers all rows.
SAMPLE_ROWS = 4000
#: Texts of more UTF-8 bytes are scored, but not learned from, so that the sample is bounded in bytes too.
SAMPLE_TEXT = 65_536


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE_ROWS) -> pd.DataFrame:
    """text (bytes) and label (0/1) of at most `most` rows that aren't held out, by a hash of the doc_id.

    Rows with a null doc_id, text or label teach nothing, nor do texts over SAMPLE_TEXT bytes; of repeated label rows the
    largest label counts, of texts of one doc_id the least.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most)
    texts = docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    out = rows.toPandas().sort_values("doc_id", ignore_index=True)
    return pd.DataFrame({"text": [bytes(t) for t in out["text"]], "y": out["y"].to_numpy(dtype="int64")})
