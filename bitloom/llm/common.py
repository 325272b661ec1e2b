"""What the operators share: shared-folder tables, whole groups out of Arrow batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The words of a text, as a Java or Python pattern of what parts them: ASCII white space only.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's place in the folder that driver and executors share: spark.checkpoint.dir, or where that is
    unset, the warehouse, which they share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/bitloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all stored tables of this application; results that were not written elsewhere go with them."""
    delete(spark, shared_folder(spark))


#: Bytes of a batch that goes to a Python worker. Spark's own bound is 10,000 rows, 35 MB of texts of 3.4 KB, which both
#: sides hold several times over. A longer text makes a batch of its own.
ARROW_BYTES = 2 << 20


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow in batches of about ARROW_BYTES; the session keeps that bound, or a lower one of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    own = conf.get(name, None)
    if own is None or not own.isdigit() or not 0 < int(own) <= ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


#: Buckets of likely(): a broadcast of so many longs at most (8 MB).
BUCKETS = 1 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS))


def likely(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Most rows of df whose `column` isn't among `wanted` dropped, before a join that needs the rest shuffled.

    Keeps every row whose hash bucket holds a wanted value. What is broadcast is a set of at most BUCKETS bucket
    numbers, however many values are wanted; with very many it keeps all rows, which costs time but no result.
    """
    name = fresh(df, "bucket")
    buckets = wanted.select(_bucket(wanted.columns[0]).alias(name)).distinct()
    return df.withColumn(name, _bucket(column)).join(F.broadcast(buckets), name, "left_semi").drop(name)


def without(df: DataFrame, column: str, unwanted: DataFrame) -> DataFrame:
    """Rows of df whose `column` is not among `unwanted` (nulls stay); only those in a bucket with an unwanted value are shuffled."""
    name = fresh(df, "bucket")
    ids = unwanted.select(F.col(unwanted.columns[0]).alias(column)).distinct()
    buckets = ids.select(_bucket(column).alias(name)).distinct()
    free = df.withColumn(name, _bucket(column)).join(F.broadcast(buckets), name, "left_anti").drop(name)
    return free.unionByName(likely(df, column, ids).join(ids, column, "left_anti").select(*df.columns))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows whose labels are never learned from."""
    return F.coalesce(crc_of_id(doc_id) % 5 == 0, F.lit(False))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by integer keys: tables of whole groups with the offsets of the groups in each."""
    rest: list[pa.Table] = []

    def cut(table: pa.Table, last: bool):
        cols = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        end = table.num_rows if last else (int(at[-1]) if len(at) else 0)
        offsets = np.concatenate([[0], at[at < end], [end]]).astype(np.int64)
        return table.slice(0, end), offsets, table.slice(end)

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(pa.Table.from_batches([batch]))
        first, last = rest[0], rest[-1]
        if all(first.column(k)[0] == last.column(k)[last.num_rows - 1] for k in keys):
            continue
        done, offsets, left = cut(pa.concat_tables(rest), False)
        rest = [left]
        if done.num_rows:
            yield done, offsets
    if rest and (whole := pa.concat_tables(rest)).num_rows:
        done, offsets, _ = cut(whole, True)
        yield done, offsets


class Forest:
    """Trees that grow by links; a link within a tree adds nothing."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def joins(self, a: int, b: int) -> bool:
        """Link a and b; whether they stood in two trees."""
        x, y = self.root(a), self.root(b)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the graph of links (a, b): component is the least node reachable.

    Each round every node moves to the neighbour of least random priority, and the graph of what they moved to is
    next; a round leaves a constant fraction of the nodes, so the rounds grow with the logarithm of the graph.
    All of it is joins and aggregations on tables in the shared folder. Null ends and self links are ignored.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(moves))
        prior = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), c.alias("n"))  # noqa: E731, B023
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near"))))
        move = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.min(prior(F.col("near"))).alias("m"))
        move = stored(move.select("node", F.least(prior(F.col("node")), F.col("m"))["n"].alias("to")), "moves")
        moves.append(move)
        a = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = stored(edges, "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("node").alias("to"), F.col("to").alias("next"))
        at = at.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    at = stored(at, "roots")
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(least, "to").select("node", "component")
