"""Resharding by minimum-cost flow: fewest moved bytes from old shards to new ones of near-equal size.

1. Every old shard is cut into blocks by hash; their sizes are counted by
   Spark.  Blocks are bounded by old shards times ``blocks``, whatever the data.
2. A minimum-cost flow from old shard sizes to new capacities (staying costs
   nothing, a moved byte its price) says how many bytes go where; whole blocks
   are then chosen for each flow.
3. Only shards whose content changes are rewritten.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OVERHEAD = 8


def size_of(text: str) -> F.Column:
    """UTF-8 bytes of the text (null: none) plus a fixed amount per row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def min_cost_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest way to send all supplies to the rooms: successive shortest paths with potentials.

    The sum of the rooms must not be less than that of the supplies.
    """
    n, m = len(supply), len(room)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def edge(u: int, v: int, capacity: int, price: int) -> None:
        graph[u].append([v, capacity, price, len(graph[v])])
        graph[v].append([u, 0, -price, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost[i][j])
    for j, r in enumerate(room):
        edge(n + j, sink, r, 0)
    potential = [0] * len(graph)
    left = sum(supply)
    while left:
        far = [None] * len(graph)
        come: list[tuple[int, int] | None] = [None] * len(graph)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k, (v, capacity, price, _) in enumerate(graph[u]):
                if capacity:
                    nd = d + price + potential[u] - potential[v]
                    if far[v] is None or nd < far[v]:
                        far[v], come[v] = nd, (u, k)
                        heapq.heappush(heap, (nd, v))
        if far[sink] is None:
            raise ValueError("the new shards cannot hold all bytes")
        for v, d in enumerate(far):
            if d is not None:
                potential[v] += d
        push, v = left, sink
        while v != source:
            u, k = come[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = come[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
        left -= push
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for v, _, _, back in graph[i]:
            if n <= v < n + m:
                flow[i][v - n] = graph[v][back][1]
    return flow


@dataclass(frozen=True)
class Plan:
    """Which new shard each block goes to, in order; ``moved`` counts the bytes that leave their shard."""

    blocks: list[tuple[int, int, int, int, int, int]]  # old shard, block, shard, first slot, rows, bytes before it in the shard
    sizes: list[int]
    moved: int
    affected: frozenset[int]


def solve(blocks: list[tuple[int, int, int, int]], new_shards: int, cost: list[list[int]] | None = None) -> Plan:
    """``blocks``: (old shard, block, rows, bytes), few enough for the driver by construction."""
    total = sum(b[3] for b in blocks)
    n_old = max((b[0] for b in blocks), default=-1) + 1
    room = [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    supply = [0] * n_old
    for old, _, _, size in blocks:
        supply[old] += size
    cost = cost or [[int(i != j) for j in range(new_shards)] for i in range(n_old)]
    flow = min_cost_flow(supply, room, cost)
    target: dict[tuple[int, int], int] = {}
    load = [0] * new_shards
    # Whole blocks for each flow, large ones first, to the destination that lacks most.
    for old in range(n_old):
        lack = {j: f for j, f in enumerate(flow[old]) if f}
        for _, block, _, size in sorted((b for b in blocks if b[0] == old), key=lambda b: (-b[3], b[1])):
            j = max(lack, key=lambda k: (lack[k], k == old, -k))
            lack[j] -= size
            target[old, block] = j
            load[j] += size
    # What whole blocks leave uneven is evened out with single blocks, fullest shard to emptiest.
    by_shard: list[list[tuple[int, int, int]]] = [[] for _ in range(new_shards)]
    for old, block, _, size in blocks:
        by_shard[target[old, block]].append((size, old, block))
    for shard in by_shard:
        shard.sort()
    for _ in range(50 * new_shards):
        high, low = max(range(new_shards), key=load.__getitem__), min(range(new_shards), key=load.__getitem__)
        gap = load[high] - load[low]
        movable = [b for b in by_shard[high] if 0 < b[0] < gap]
        if not movable:
            break
        block = min(movable, key=lambda b: (abs(gap - 2 * b[0]), b))
        by_shard[high].remove(block)
        by_shard[low].append(block)
        load[high], load[low] = load[high] - block[0], load[low] + block[0]
        target[block[1], block[2]] = low
    out, slots, before, moved, affected = [], [0] * new_shards, [0] * new_shards, 0, set()
    for old, block, rows, size in sorted(blocks):
        j = target[old, block]
        out.append((old, block, j, slots[j], rows, before[j]))
        slots[j] += rows
        before[j] += size
        if j != old:
            moved += size
            affected |= {old, j}
    return Plan(out, load, moved, frozenset(affected))


def plan(docs: DataFrame, old_shard: F.Column, new_shards: int, blocks: int = 1024, id_col: str = "doc_id", text_col: str = "text", cost: list[list[int]] | None = None) -> Plan:
    """Counts the blocks of the old shards (numbered from 0) and solves the flow."""
    sizes = docs.select(old_shard.cast("int").alias("old"), _block(blocks, id_col, text_col).alias("block"), size_of(text_col).alias("size"))
    counted = sizes.groupBy("old", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")).collect()
    return solve([(r["old"], r["block"], r["rows"], r["size"]) for r in counted], new_shards, cost)


def _block(blocks: int, id_col: str, text_col: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).cast("int")


def reshard(
    docs: DataFrame, old_shard: F.Column, new_shards: int, folder: str, blocks: int = 1024, file_bytes: int = 32 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Moves all rows to ``new_shards`` shards of near-equal bytes; returns id, text, ``shard``, ``slot`` of every row.

    Rows of affected shards are written to ``folder`` (Parquet, one subfolder
    per shard, files of about ``file_bytes``) and returned from there; rows of
    the other shards stay where they are.  Slots count from 0 within a shard
    without gaps.  Null texts count their fixed bytes, repeated rows are placed
    each for itself, an empty table gives no rows.  The plan has at most old
    shards times ``blocks`` entries, so it may be broadcast.  One row larger
    than a shard's share makes the sizes uneven; rows equal in id and text
    share a block.
    """
    spark = docs.sparkSession
    made = plan(docs, old_shard, new_shards, blocks, id_col, text_col)
    table = spark.createDataFrame(
        [(old, block, shard, first, before // file_bytes, shard in made.affected) for old, block, shard, first, _, before in made.blocks],
        "old int, block int, shard int, first long, file long, affected boolean")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), old_shard.cast("int").alias("old"), _block(blocks, id_col, text_col).alias("block"))
    rows = rows.join(F.broadcast(table), ["old", "block"]).repartition("shard", "file")
    # A block lies in one file, so its rows are numbered without another shuffle.
    rank = F.row_number().over(Window.partitionBy("shard", "file", "old", "block").orderBy("_id", F.xxhash64("_text")))
    placed = rows.withColumn("slot", F.col("first") + rank - 1)
    columns = [F.col("_id").alias(id_col), F.col("_text").alias(text_col), "shard", "slot"]
    placed.where("affected").select(*columns).write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    out = read(spark, folder, placed.select(*columns))
    if len(made.affected) < new_shards:
        out = out.unionByName(placed.where(~F.col("affected")).select(*columns))
    return out


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(folder)
