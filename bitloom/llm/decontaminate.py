"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

1. Index: one pass over the documents stores a posting (term, document, position) for each word that a test item has, and
   one that tells each document's number of words. Postings of a task make one file; no posting is shuffled for it.
2. Intersect: a test window proposes a start, position less offset, for each posting of its rarest term. Starts are
   intersected with the postings of the second rarest term by shuffled joins, and only what is left meets the lists of
   all other terms, in the documents that still have a start.
3. A start at which every term stands at its offset is an exact phrase. One around which every term stands within `slop`
   words of the window's extent is a proximity match.

A document is known by two hashes of its id and text, so nothing hangs on numbers that another run could deal otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import likely, stored, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, once A-Z are lower-cased: all ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Proximity matches reach so many words beyond a window's extent on either side.
SLOP = 3
#: What a stored table may hold, in bytes, to be broadcast; larger ones are joined by shuffles.
BROADCAST = 8 << 20


def bounded(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df marked for broadcast if its stored files, or those of the table `of` that it has some rows and columns of, are
    no more than BROADCAST bytes."""
    size = (df if of is None else of)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= BROADCAST else df


def few(df: DataFrame) -> DataFrame:
    """df in no more partitions than there are cores. Tables of the test items are stored so: they are small, but would
    make a file for each shuffle partition, and for files on a local disk executors start chmod processes."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def tokens(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BETWEEN), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id (string), win (array of words), len: the windows of each item; a shorter item is one, a wordless none."""
    t = items.select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("t")).where("size(t) > 0 and item_id is not null")
    t = t.select("item_id", "t", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t") - (size - 1)))).alias("i"))
    return t.select("item_id", F.slice("t", F.col("i"), F.lit(size)).alias("win")).distinct().withColumn("len", F.size("win"))


KEY = ("k1", "k2")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, text: rows of equal id and text have equal keys."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(7), "doc_id").alias("k2"), "text")


def postings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The stored index: term, k1, k2, pos (from 1) of each word of docs among `words` (word, term); and for each row of
    docs a posting of term 0 with its doc_id, whose position is its number of words."""
    t = keyed(docs).select("doc_id", *KEY, F.concat(F.array(F.lit("")), tokens(F.col("text"))).alias("t"))
    each = t.select("doc_id", *KEY, (F.size("t") - 1).alias("n"), F.posexplode("t").alias("at", "word"))
    head = F.col("at") == 0
    post = each.join(bounded(words), "word").select("term", *KEY, F.when(head, F.col("n")).otherwise(F.col("at")).alias("pos"), F.when(head, F.col("doc_id")).alias("doc_id"))
    return stored(post, "postings")


def lists(wins: DataFrame, words: DataFrame, post: DataFrame) -> DataFrame:
    """win, item_id, len, by: each window's (n, off, term), rarest first; windows with a term that no document has are gone."""
    counts = post.where("term > 0").groupBy("term").agg(F.count("*").alias("n"))
    terms = wins.select("item_id", "win", "len", F.posexplode("win").alias("off", "word")).join(bounded(words), "word").join(bounded(counts, words), "term")
    by = terms.groupBy("item_id", "win", "len").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("by")).where(F.size("by") == F.col("len"))
    return stored(few(by.select(F.xxhash64("item_id", "win").alias("id"), F.xxhash64("win", F.lit(3), "item_id").alias("id2"), "item_id", "len", "by")), "lists")


def near(post: DataFrame, low: Column, high: Column, width: int) -> tuple[DataFrame, Column]:
    """post with `slot`, and the slots of the positions from low to high, an extent of at most `width` words."""
    slot = lambda c: F.floor(c / width).cast("long")
    return post.withColumn("slot", slot(F.col("pos"))).select("term", *KEY, "slot", "pos"), F.explode(F.sequence(slot(low), slot(high)))


def intersected(post: DataFrame, by: DataFrame, words: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """k1, k2, id, id2, item_id, len, start, exact: the windows' matches; with slop 0 the exact ones only.

    Each join is by equality on document, term and place: the position itself, or a slot of as many positions as a
    window's extent with its slop, of which an extent touches two at most.
    """
    mine = ("id", "id2", "len")
    word = post.where("term > 0").drop("doc_id")
    best = by.select(*mine, *(F.col("by")[F.least(F.lit(i), F.size("by") - 1)][f].alias(f"{f}{i}") for i in (0, 1) for f in ("term", "off")))
    start = F.col("pos") - F.col("off0")
    first = word.join(bounded(best), F.col("term") == F.col("term0")).select(*KEY, *mine, start.alias("start"), "term1", "off1")
    wanted = by.select(F.explode("by.term").alias("term"))
    second = word.join(bounded(best.select(F.col("term1").alias("term")).distinct(), words), "term", "left_semi")
    reach = F.col("start") - slop, F.col("start") + F.col("len") - 1 + slop
    if slop:
        placed, slots = near(second, *reach, size + 2 * slop)
        cand = first.withColumn("slot", slots).join(placed.withColumnRenamed("term", "term1"), [*KEY, "term1", "slot"]).where(F.col("pos").between(*reach))
    else:
        cand = first.where("start >= 1").withColumn("pos", F.col("start") + F.col("off1")).join(second.withColumnRenamed("term", "term1"), [*KEY, "term1", "pos"], "left_semi")
    cand = stored(cand.select(*KEY, *mine, "start").distinct(), "starts")
    rest = likely(word, "k1", cand.select("k1")).join(bounded(wanted.distinct(), words), "term", "left_semi")
    need = cand.join(by.select("id", "id2", F.explode("by").alias("b")), ["id", "id2"]).select(*KEY, *mine, "start", "b.off", "b.term")
    if slop:
        placed, slots = near(rest, *reach, size + 2 * slop)
        met = need.withColumn("slot", slots).join(placed, [*KEY, "term", "slot"]).where(F.col("pos").between(*reach))
    else:
        met = need.withColumn("pos", F.col("start") + F.col("off")).join(rest, [*KEY, "term", "pos"])
    there = F.col("pos") == F.col("start") + F.col("off")
    at = lambda c: F.size(F.collect_set(F.when(c, F.col("off"))))
    full = met.groupBy(*KEY, *mine, "start").agg(at(F.lit(True)).alias("n"), at(there).alias("m")).where(F.col("n") == F.col("len"))
    return full.select(*KEY, *mine, "start", (F.col("m") == F.col("len")).alias("exact")).join(by.select("id", "id2", "item_id"), ["id", "id2"])


def index(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The postings of docs for the words of items, the items' windows by rarest term, and the words with their terms."""
    wins = stored(few(windows(items, size)), "windows")
    each = few(wins.select(F.explode("win").alias("word")).distinct()).select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    none = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.col("id").alias("term"))
    words = stored(each.union(none), "words")
    post = postings(docs, words)
    return post, lists(wins, words, post), words


def heads(post: DataFrame) -> DataFrame:
    return post.where("term = 0").select("doc_id", *KEY, F.col("pos").cast("long").alias("n_words"))


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, start, len, item_id, exact: a row for each match of a window of items in a row of docs.

    slop 0: exact phrases. Else also proximity: all words of the window stand within slop words of its extent around its
    rarest word. Starts count words from 1. Null texts and items have no words; rows of one doc_id and text each have
    their own matches; empty tables match nothing. Very long texts are indexed whole. Other columns are not read.
    """
    post, by, words = index(docs, items, size)
    return intersected(post, by, words, size, slop).join(heads(post), [*KEY]).select("doc_id", "start", "len", "item_id", "exact")


def contamination(docs: DataFrame, items: DataFrame, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted array of item_ids), contaminated, n_near for each row of docs
    (doc_id, text).

    Words are runs of other than ASCII non-alphanumerics after lower-casing A-Z; a word inside an occurrence of a
    10-word window of an item (or of a whole shorter item) is hit. n_near counts the items with a proximity match, exact
    ones included. Null texts have no words; null or empty tables and items without words hit nothing; repeated rows of
    docs stay apart. Very long texts are indexed whole. Other columns are not read.
    """
    post, by, words = index(docs, items)
    hits = intersected(post, by, words, WINDOW, slop)
    before = Window.partitionBy(*KEY).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    exact = hits.where("exact").select(*KEY, "start", "len").distinct()
    spans = exact.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))))
    hit = spans.groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    of = hits.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("items"), F.count_distinct("item_id").alias("n_near"))
    df = heads(post).join(of.join(hit, [*KEY], "left"), [*KEY], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return df.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("items") > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contamination() with the hash of the item_ids in place of their list; same rules."""
    out = contamination(docs, items, SLOP)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without any word hit, with docs' own columns; of rows that share a doc_id all go if one is hit.
    Null ids and texts stay; empty tables and items without words drop nothing."""
    hit = stored(contamination(docs, items).where("contaminated and doc_id is not null").select("doc_id"), "hit")
    return without(docs, "doc_id", hit)
