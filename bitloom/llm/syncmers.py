"""Document fingerprints from closed syncmers over code points, in DataFrame operations only.

A k-mer is K = 20 consecutive code points with 17 inner s-mers of S = 4. It is chosen if its first or its last s-mer
has the least hash of them all. The choice depends on the k-mer alone, so the same passage gives the same anchors in
any text, whether or not it has white space. A fingerprint is the SKETCH least distinct hashes of the chosen k-mers,
and likeness is the Jaccard estimate of two such sketches. A text under SHORT code points, half of which has few
k-mers or none, has the hashes of all its s-mers instead, and of its code points if it is shorter than an s-mer. Two texts are compared on the finest of these
that both have, never on two different ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import SPACE

SKETCH = 64
K, S = 20, 4
#: Half of a text of so many code points has 13 chosen k-mers on average.
SHORT = 256
#: Code points of a text that are looked at together; pieces overlap, so k-mers are those of the whole text.
PIECE = 65_536
#: Rows that are ordered together when each looks for its successor, and the most such buckets.
BUCKET_ROWS, BUCKETS, KNOTS = 512, 16_384, 64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def starts(x: Column, n: int) -> Column:
    """The elements of array x at which n consecutive ones begin."""
    return F.slice(x, F.lit(1), F.greatest(F.size(x) - (n - 1), F.lit(0)))


def grams(c: Column, n: int) -> Column:
    """Hashes of all runs of n code points; c are the code points."""
    return F.transform(starts(c, n), lambda x, i: F.xxhash64(x, *(F.get(c, i + j) for j in range(1, n))))


def closed(c: Column) -> Column:
    """At each k-mer's place its hash, null where it isn't chosen; c are the code points."""
    last = K - S

    def chosen(h: Column, four: Column) -> Column:
        # the inner s-mers, at 1 to last - 1, by fours of which the last two overlap
        inner = lambda i: F.least(*(F.get(four, i + j) for j in (1, 5, 9, last - 4)))
        whole = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(0, last + 1, S)))
        return F.transform(starts(h, last + 1), lambda x, i: F.when(F.least(x, F.get(h, i + last)) <= inner(i), whole(i)))

    fours = lambda h: F.transform(h, lambda x, i: F.least(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3)))
    return let(grams(c, S), lambda h: let(fours(h), lambda four: chosen(h, four)))


def pieces(text: Column, width: int, then: Callable[[Column, Column], Column]) -> Column:
    """Array of then(code points, offset) of each piece of the text; each run of `width` code points is in one piece."""
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(PIECE))
    signs = lambda o: F.array_remove(F.split(F.substring(text, o + 1, F.lit(PIECE + width - 1)), ""), "")
    return F.transform(at, lambda o: let(signs(o), lambda c: then(c, o)))


def least(hashes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.filter(hashes, lambda x: x.isNotNull()))), 1, SKETCH)


def sketch(text: Column) -> Column:
    """The SKETCH least hashes of the chosen k-mers, none for a short text."""
    return F.when(F.length(text) >= SHORT, least(F.flatten(pieces(text, K, lambda c, _: least(closed(c)))))).otherwise(F.array().cast("array<bigint>"))


def plain(text: Column, n: int) -> Column:
    """The SKETCH least hashes of all runs of n code points."""
    return least(F.flatten(pieces(text, n, lambda c, _: least(grams(c, n)))))


def own(text: Column, sk: Column) -> Column:
    """The fingerprint of a text whose chosen k-mers have the sketch sk."""
    return F.when(F.size(sk) > 0, sk).when(F.length(text) >= S, plain(text, S)).otherwise(plain(text, 1))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two sketches; 1 for two empty ones."""
    both = F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, SKETCH)
    met = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(both, met))


def near(text: Column, sk: Column, other: Column, other_sk: Column) -> Column:
    """Likeness of two texts with the sketches of their chosen k-mers, on the finest basis that both have."""
    by = lambda n: let(plain(text, n), lambda a: let(plain(other, n), lambda b: likeness(a, b)))
    both = lambda x, y, n: (x >= n) & (y >= n)
    chosen = both(F.size(sk), F.size(other_sk), 1)
    return F.when(chosen, likeness(sk, other_sk)).when(both(F.length(text), F.length(other), S), by(S)).otherwise(by(1))


def shown(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, pos (of the word it begins in or after, from 0), at (in code points, from 0), hash: every closed syncmer
    of every text, for positional matching.

    Beginnings of words and anchors are sorted together, so an anchor's word is its rank less the anchors before it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spot = lambda at, kind, nth, hash_: F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"), nth.cast("long").alias("nth"), hash_.cast("long").alias("hash"))
    mers = lambda c, o: F.filter(F.transform(closed(c), lambda h, i: spot(o + i, 1, F.lit(0), h)), lambda x: x["hash"].isNotNull())
    # a piece is seen with the code point after it; that after white space begins a word
    begins = lambda c, o: F.filter(F.transform(starts(c, 2), lambda x, i: F.when(x.rlike(SPACE) & ~F.get(c, i + 1).rlike(SPACE), spot(o + i + 1, 0, F.lit(0), F.lit(0)))), lambda x: x.isNotNull())
    first = F.when(F.length(text) > 0, F.when(~F.substring(text, 1, 1).rlike(SPACE), F.array(spot(F.lit(0), 0, F.lit(0), F.lit(0)))))
    df = docs.select("doc_id", F.flatten(pieces(text, K, mers)).alias("m"), F.flatten(pieces(text, 2, begins)).alias("b"), first.alias("f"))
    nth = F.transform("m", lambda x, i: spot(x["at"], 1, i, x["hash"]))
    every = F.sort_array(F.concat(F.coalesce("f", F.array().cast(df.schema["m"].dataType)), "b", nth))
    out = df.select("doc_id", F.posexplode(every).alias("rank", "e")).where("e.kind = 1")
    return out.select("doc_id", F.greatest(F.col("rank") - F.col("e.nth") - 1, F.lit(0)).cast("int").alias("pos"), F.col("e.at").alias("at"), F.col("e.hash").alias("hash"))


def bucketed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with `bucket`, rising with doc_id (null: -1), and for each bucket (`bucket`) the doc_id (`first`) that
    comes after its rows in circular descending order.

    Buckets are linear between at most KNOTS quantiles of doc_id. Only the quantiles and a row per bucket
    (BUCKETS + 1 at most) reach the driver.
    """
    rows = docs.count()
    knots = sorted({x for x in docs.select(F.percentile_approx("doc_id", [i / KNOTS for i in range(KNOTS + 1)], 10_000)).first()[0] or []} | {0})
    each = max(1, min(BUCKETS, rows // BUCKET_ROWS) // max(1, len(knots)))
    known = F.array(*(F.lit(k).cast("long") for k in knots))
    at = F.size(F.filter(known, lambda k: k <= F.col("doc_id")))
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    step = F.least(F.lit(each - 1), F.floor((F.col("doc_id").cast("double") - low) / (high - low) * each).cast("int"))
    inside = F.when((F.col("_at") > 0) & (F.col("_at") < len(knots)), step).otherwise(0)
    df = docs.withColumn("_at", at).withColumn("_low", F.get(known, F.col("_at") - 1)).withColumn("_high", F.get(known, F.col("_at")))
    df = df.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_at") * each + inside)).drop("_at", "_low", "_high")
    tops = sorted((tuple(r) for r in df.groupBy("bucket").agg(F.max("doc_id")).collect()), reverse=True)
    after = [(b, tops[(i + 1) % len(tops)][0], tops[(i + 1) % len(tops)][1]) for i, (b, _) in enumerate(tops)]
    return df, docs.sparkSession.createDataFrame(after, "bucket int, next_bucket int, first long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by descending doc_id (null last, equal ids by descending text; after the last comes the first). Null
    texts are empty. An empty table gives no rows, repeated rows stay. Only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df, after = bucketed(docs)
    heads = df.join(F.broadcast(after.withColumnRenamed("bucket", "before")), (F.col("bucket") == F.col("next_bucket")) & F.col("doc_id").eqNullSafe(F.col("first")))
    heads = heads.groupBy(F.col("before").alias("bucket")).agg(F.max("text").alias("head_text")).withColumn("head_sk", sketch(F.col("head_text")))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    df = df.withColumn("sk", sketch(F.col("text"))).withColumns({"after_text": F.lead("text").over(order), "after_sk": F.lead("sk").over(order)})
    df = df.join(heads, (df["bucket"] == heads["bucket"]) & df["after_text"].isNull(), "left")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.select("doc_id", "text", "sk", F.length("text").alias("n_chars"), F.coalesce("after_text", "head_text").alias("next_text"), F.coalesce("after_sk", "head_sk").alias("next_sk"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    df = df.withColumn("esk", sketch(F.col("edited")))
    text, sk, edited, esk = (F.col(c) for c in ("text", "sk", "edited", "esk"))
    out = df.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), shown(own(text, sk)).alias("fingerprint"), shown(own(edited, esk)).alias("edited_fingerprint"), near(text, sk, edited, esk).alias("near_edited"), near(text, sk, F.col("next_text"), F.col("next_sk")).alias("near_next"))
    return out
