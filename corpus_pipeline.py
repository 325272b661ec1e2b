"""A training corpus from `documents`: classify, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import decontaminate, mixing, near_dedup, quality, sharding
from bitloom.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

OLD_SHARDS, NEW_SHARDS = 12, 8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from this stage's own labelled documents, doesn't reject."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Stages on word shingles link at similarity 0.8 or more."""
    return near_dedup.deduplicated(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def reshard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their new shard and slot, moved from one shard per source by the cheapest flow."""
    return sharding.reshard(docs, F.pmod(F.crc32(F.encode("source", "UTF-8")), F.lit(OLD_SHARDS)), NEW_SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", reshard),
]

#: No SQL: a trained classifier and sketches decide what stays. Tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
