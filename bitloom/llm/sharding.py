"""Resharding by minimum-cost flow.

Old shards supply their bytes, new shards demand their capacities, and a byte that stays where it is costs nothing.
The cheapest flow between them, a graph of shards only, says how many bytes go from each old shard to each new one.
Each old shard is a row of hashed blocks; the flow cuts that row into stretches, so whole blocks move and only the
few blocks at the cuts are parted by document.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import stored

#: Blocks of each old shard: with the shards they bound what the driver sees and what is broadcast.
BLOCKS = 256


def cheapest_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """flow[i][j] of least total cost that meets all supplies and demands (equal sums), by successive shortest paths."""
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, need = list(supply), list(demand)
    price = [0] * (n + m)
    while any(left):
        # Dijkstra on reduced costs from all old shards with bytes left
        dist: dict[int, int] = {}
        heap = [(0, i, -1) for i in range(n) if left[i]]
        heapq.heapify(heap)
        via: dict[int, int] = {}
        end = -1
        while heap:
            d, v, u = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v], via[v] = d, u
            if v >= n:
                if need[v - n] and end < 0:
                    end = v
                    break
                nexts = ((i, -cost[i][v - n]) for i in range(n) if flow[i][v - n])
            else:
                nexts = ((n + j, cost[v][j]) for j in range(m))
            for w, c in nexts:
                if w not in dist:
                    heapq.heappush(heap, (d + c + price[v] - price[w], w, v))
        assert end >= 0, "supplies and demands differ"
        for v in range(n + m):
            price[v] += min(dist.get(v, dist[end]), dist[end])
        path, v = [], end
        while v >= 0:
            path.append(v)
            v = via[v]
        path.reverse()
        steps = list(zip(path, path[1:], strict=False))
        push = min([left[path[0]], need[end - n], *(flow[b][a - n] for a, b in steps if a >= n)])
        for a, b in steps:
            if a < n:
                flow[a][b - n] += push
            else:
                flow[b][a - n] -= push
        left[path[0]] -= push
        need[end - n] -= push
    return flow


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1, for the line or record end; a null text has none."""
    return (F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-8")) + 1).cast("long")


def pieces(blocks: dict[tuple[int, int], int], flow: Sequence[Sequence[int]]) -> list[tuple[int, int, int, int, int]]:
    """(old, block, low, high, new): byte stretches of each block and where they go."""
    out = []
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (old, block), size in sorted(blocks.items()):
        by[old].append((block, size))
    for old, row in by.items():
        goes = [(j, x) for j, x in enumerate(flow[old]) if x]
        ends = [sum(x for _, x in goes[: k + 1]) for k in range(len(goes))]
        at = 0
        for block, size in row:
            low = at
            while low < at + size:
                k = bisect_right(ends, low)
                high = min(at + size, ends[k])
                out.append((old, block, low - at, high - at, goes[k][0]))
                low = high
            at += size
    return out


def plan(docs: DataFrame, old: Column, shards: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, old, shard, slot (and `extra` columns) of each row of docs (doc_id, text).

    `old` is each row's present shard, a small whole number (null: 0). New shards are 0 to shards - 1 with near-equal bytes; old shard
    k keeps what fits into new shard k. Slots count each new shard's rows from 0. Null texts have size 1; null ids are
    ids like others; repeated rows are placed apart; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    # by id and text, so that rows of one id (or of none) are spread over the blocks too
    block = F.pmod(F.xxhash64("doc_id", crc, F.lit(23)), F.lit(BLOCKS)).cast("int")
    sized = docs.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old"), block.alias("block"), *extra)
    sized = stored(sized, "sizes")
    blocks = {(r.old, r.block): r.n for r in sized.groupBy("old", "block").agg(F.sum("size").alias("n")).collect()}
    supply = [0] * (max((o for o, _ in blocks), default=-1) + 1)
    for (o, _), n in blocks.items():
        supply[o] += n
    cost = [[int(i != j) for j in range(shards)] for i in range(len(supply))]
    cut = pieces(blocks, cheapest_flow(supply, capacities(sum(supply), shards), cost))
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(cut)], "piece int, old int, block int, low long, high long, shard int")
    order = Window.partitionBy("old", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sized.withColumns({"end": F.sum("size").over(order), "rank": F.row_number().over(order)})
    # a document goes where its middle byte lies; the pieces of a block leave no gap
    middle = F.col("end") - F.ceil(F.col("size") / 2)
    placed = ranked.join(F.broadcast(table), ["old", "block"]).where((middle >= F.col("low")) & (middle < F.col("high")))
    placed = stored(placed.drop("end", "low", "high"), "placed")
    counts = {r.piece: (r.n, r.first) for r in placed.groupBy("piece").agg(F.count("*").alias("n"), F.min("rank").alias("first")).collect()}
    start, base = [0] * shards, []
    for i, p in enumerate(cut):
        n, first = counts.get(i, (0, 1))
        base.append((i, start[p[4]] - first))
        start[p[4]] += n
    offsets = spark.createDataFrame(base, "piece int, base long")
    out = placed.join(F.broadcast(offsets), "piece")
    return out.select("doc_id", "size", "text_crc32", "old", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), *extra)


def moved(planned: DataFrame) -> DataFrame:
    """shard, rewritten (whether any row enters or leaves it), rows and bytes in, of a plan: the files to write again."""
    stays = F.col("old") == F.col("shard")
    side = F.explode(F.when(stays, F.array(F.struct(F.col("shard").alias("s"), F.lit(0).alias("m"), F.lit(0).alias("in_")))).otherwise(F.array(F.struct(F.col("shard").alias("s"), F.lit(1).alias("m"), F.lit(1).alias("in_")), F.struct(F.col("old").alias("s"), F.lit(1).alias("m"), F.lit(0).alias("in_")))))
    each = planned.select("size", side.alias("e"))
    return each.groupBy(F.col("e.s").alias("shard")).agg((F.max("e.m") > 0).alias("rewritten"), F.sum("e.in_").alias("rows_in"), F.sum(F.col("size") * F.col("e.in_")).alias("bytes_in"))


def rewrite(docs: DataFrame, path: str) -> DataFrame:
    """Write the shards of resharded docs that change under `path`, one folder each; the others' files stay as they are."""
    changed = moved(docs).where("rewritten").select("shard")
    out = docs.join(F.broadcast(changed), "shard", "left_semi")
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
    return changed


def reshard(docs: DataFrame, old: Column, shards: int) -> DataFrame:
    """docs with size, text_crc32, old, shard and slot (in place of columns of those names), by the rules of plan().

    Each row is placed with all its columns, so rows of one doc_id, or of none, need not be found again: copies and null
    ids stay as they are. An empty table gives no rows; very long texts move whole.
    """
    mine = ("size", "text_crc32", "old", "shard", "slot")
    rows = docs.select("doc_id", "text", old.alias("old"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine)).alias("row"))
    return plan(rows, F.col("old"), shards, ("row",)).select("row.*", *mine)
