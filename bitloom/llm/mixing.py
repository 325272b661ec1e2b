"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt out one by one, in closed form but for the last few: to sources by highest quotients
target / (2 * words + 1), then each source's words to its shards by the shards' sizes in the same way, so every shard
has an integer quota and a source's quotas sum to its target, however small it is. Within a shard documents stand in a
seeded order and the quota is a number of whole passes and a stretch from the order's begin.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import SPACE, fresh, stored

WEIGHTS = (5, 2, 1)
#: A source is repeated at most so often.
REPEATS = 3
#: A source has one shard for so many rows of its own, and so many shards at most.
SHARD_ROWS, SHARDS = 1_000, 4096


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: int = REPEATS) -> list[float]:
    """Shares of total by weight; those above repeats * size stop there and the others share the rest."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def apportion(claims: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Sainte-Lague: each seat to the highest quotient claim / (2 * seats + 1), within caps; ties to the first.

    With n claims the final divisor is within n / (2 * seats) of whole / seats, so each has for certain its exact share
    less n / 2 of its part of the whole and one half; caps of others only add. At most about 3 * n seats, and those
    above caps, are dealt one by one.
    """
    whole = sum(claims)
    if whole <= 0 or seats <= 0:
        return [0] * len(claims)
    out = [min(c, max(0, int(seats * x / whole - len(claims) / 2 * x / whole - 1))) for x, c in zip(claims, caps, strict=True)]
    heap = [(-x / (2 * n + 1), i) for i, (x, n, c) in enumerate(zip(claims, out, caps, strict=True)) if n < c and x > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-claims[i] / (2 * out[i] + 1), i))
    return out


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard of each row of docs (doc_id, text, source).

    Sources in order of code points, null last, weigh 5, 2, 1, 5, ... and share all words. `taken` counts the words
    taken of a row, repeats included, at most 3 * size. Null and wordless texts have size 0 and nothing taken; a null
    doc_id is an id like others; repeated rows are taken apart; an empty table gives no rows. Other columns are not
    read. The driver holds SHARDS
    numbers for each source at most, a matter of configuration, never a row per document.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")).withColumn("key", key), "sizes")
    split = [(r.key, max(1, min(SHARDS, r["count"] // SHARD_ROWS))) for r in sized.groupBy("key").count().collect()]
    sized = sized.join(F.broadcast(docs.sparkSession.createDataFrame(split, "key string, shards int")), "key")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("shards")).cast("int")).drop("shards")
    cells = {(r.key, r.shard): r.n for r in sized.groupBy("key", "shard").agg(F.sum("size").alias("n")).collect()}
    shards_of: dict[str, list[int]] = defaultdict(list)
    for k, s in sorted(cells):
        shards_of[k].append(s)
    names = sorted(shards_of, key=lambda k: (k == "~", k))
    sizes = {k: sum(cells[k, s] for s in shards_of[k]) for k in names}
    total = sum(sizes.values())
    goal = targets([sizes[k] for k in names], [WEIGHTS[i % 3] for i in range(len(names))], total)
    quota = apportion(goal, round(sum(goal)), [REPEATS * sizes[k] for k in names])
    rows = []
    for k, want, words in zip(names, goal, quota, strict=True):
        own = shards_of[k]
        each = apportion([cells[k, s] for s in own], words, [REPEATS * cells[k, s] for s in own])
        rows += [(k, s, sizes[k], float(want), cells[k, s], n) for s, n in zip(own, each, strict=True)]
    plan = docs.sparkSession.createDataFrame(rows, "key string, shard int, source_size long, target double, cell long, quota long")
    order = Window.partitionBy("key", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = sized.withColumn("end", F.sum("size").over(order)).join(plan, ["key", "shard"])
    passes = F.when(F.col("cell") > 0, F.floor(F.col("quota") / F.greatest("cell", F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("quota") - passes * F.col("cell")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return df.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"), "shard")


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as its taken words hold its own, to the nearest whole.

    Rows of the same doc_id are counted together; a null doc_id is an id like others.
    """
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    id_, times, copy = (fresh(docs, n) for n in ("id_", "times", "copy"))
    taken = mix(docs, seed).groupBy(key(F.col("doc_id")).alias(id_)).agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias(times))
    out = docs.withColumn(id_, key(F.col("doc_id"))).join(taken.where(F.col(times) > 0), id_)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
