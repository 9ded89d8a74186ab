"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move fewest bytes.

A document's size is its UTF-8 bytes plus 1. Documents form blocks inside their old shard, by a hash of the text, so
equal texts share a block and stay together; only a group of equal texts beyond 1 / split of a fair share is dealt into
several blocks, row by row, as it could not be balanced otherwise. That limit is a parameter: split=None keeps every group
of equal texts together, whatever it does to the balance. The driver sees the sizes of at most shards * BLOCKS blocks,
a constant, solves the flow between old and new shards (successive shortest paths, any cost matrix), and fills each
flow with blocks, the largest that fit first. Sizes end near equal: a shard misses its capacity by about a block.

The block table goes to executors by broadcast; its size is bounded by the same constant. Slots count rows from 0
within a shard, without gaps: row numbers inside small cells of a shard, by hash, plus the cells' offsets.

Rows get a number when they are first written to the shared folder, without their texts; a group is dealt, and slots are
given, by that number, so any number of rows with a null id, or with one id, are spread like others.

Null texts count as empty. Null ids and repeated rows are placed like any other row. Other columns are ignored (and
kept by rewritten()). An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, drop_cut

SHARDS, OLD_SHARDS, BLOCKS, SPLIT, CELL = 16, 12, 1024, 64, 50_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] of least total cost that ships all supply within capacities; successive shortest paths."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are too small")
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    potential = [0] * len(graph)
    while True:
        distance, back = {source: 0}, {}
        heap, done = [(0, source)], set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for k, (b, room, price, _) in enumerate(graph[a]):
                e = d + price + potential[a] - potential[b]
                if room and (b not in distance or e < distance[b]):
                    distance[b], back[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        if sink not in back:
            break
        for a in range(len(graph)):
            potential[a] += distance.get(a, max(distance.values()))
        path, at = [], sink
        while at != source:
            a, k = back[at]
            path.append(graph[a][k])
            at = a
        pushed = min(x[1] for x in path)
        for x in path:
            x[1] -= pushed
            graph[x[0]][x[3]][1] += pushed
    # what an arc has carried is the room of its reverse
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for b, _, _, k in graph[i]:
            if n <= b < n + m:
                flow[i][b - n] = graph[b][k][1]
    return flow


@dataclass
class Plan:
    """Where each block (old shard, block) goes, the flow it realises, and the shards whose files change."""

    target: dict[tuple[int, int], int]
    flow: list[list[int]]
    touched: set[int]


def planned(blocks: dict[tuple[int, int], int], old: int, capacity: list[int], cost: list[list[int]] | None = None) -> Plan:
    supply = [0] * old
    for (i, _), size in blocks.items():
        supply[i] += size
    cost = cost or [[int(i != j) for j in range(len(capacity))] for i in range(old)]
    flow = min_cost_flow(supply, capacity, cost)
    room, target, left = [list(x) for x in flow], {}, list(capacity)
    by_shard: dict[int, list[tuple[int, int]]] = {}
    for (i, b), size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        by_shard.setdefault(i, []).append((size, b))
    loose = []
    for i, found in by_shard.items():
        for size, b in found:
            fits = [j for j in range(len(capacity)) if room[i][j] >= size]
            if not fits:
                loose.append((size, i, b))
                continue
            j = min(fits, key=lambda j: (cost[i][j], -room[i][j], j))
            room[i][j] -= size
            left[j] -= size
            target[i, b] = j
    for size, i, b in sorted(loose, reverse=True):  # what no single flow can take whole: where most room is left
        j = max(range(len(capacity)), key=lambda j: (left[j], -cost[i][j], -j))
        left[j] -= size
        target[i, b] = j
    touched = {x for (i, _), j in target.items() if i != j for x in (i, j)}
    return Plan(target, flow, touched)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def resharded(docs: DataFrame, shards: int = SHARDS, old_shard: Column | None = None, old: int = OLD_SHARDS, capacity: list[int] | None = None, cost: list[list[int]] | None = None, blocks: int = BLOCKS, carry: bool = False, split: int | None = SPLIT) -> tuple[DataFrame, Plan]:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for each row of docs, and the plan behind it.

    old_shard: its present shard, 0 to old - 1 (default: a hash of the text); capacity: bytes by new shard (default: even);
    carry: with the row of docs itself, as a struct `row`. split: groups of equal texts beyond 1 / split of a fair share are
    dealt into several blocks; None: never.
    """
    spark = docs.sparkSession
    present = F.pmod(text_hash(), F.lit(old)) if old_shard is None else old_shard
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), present.cast("int").alias("old_shard"), text_hash().alias("h"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    rows = cut(rows.withColumn("number", F.monotonically_increasing_id()))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    capacity = capacity or [total[0] // shards + (j < total[0] % shards) for j in range(shards)]
    fair = max(1, total[0] // max(1, shards * split)) if split else total[0]
    # at most shards * split groups can be beyond 1 / split of a fair share: a bounded broadcast
    large = rows.groupBy("old_shard", "h").agg(F.sum("size").alias("whole"), F.count("*").alias("copies")).where((F.col("whole") > fair) & (F.col("copies") > 1))
    large = large.select("old_shard", "h", F.least(F.ceil(F.col("whole") / F.lit(fair)), F.lit(1 << 20)).cast("long").alias("pieces"))
    rows = rows.join(F.broadcast(large), ["old_shard", "h"], "left")
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("number"), F.col("pieces"))).otherwise(F.lit(0))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h", piece), F.lit(blocks)).cast("int")).drop("pieces")
    sizes = {(r["old_shard"], r["block"]): r["size"] for r in rows.groupBy("old_shard", "block").agg(F.sum("size").alias("size")).collect()}
    plan = planned(sizes, old, capacity, cost)
    table = spark.createDataFrame([(i, b, j) for (i, b), j in plan.target.items()], "old_shard int, block int, shard int")
    rows = rows.join(F.broadcast(table), ["old_shard", "block"])
    cells = max(4, total[1] // (shards * CELL) + 1)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(5), "number"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = counts.selectExpr("shard", "cell", "sum(n) OVER (PARTITION BY shard ORDER BY cell) - n AS start")
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY shard, cell ORDER BY number) - 1 AS place")
    # one row per cell of about CELL rows
    out = ranked.join(offsets, ["shard", "cell"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long"))
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot", *(["row"] if carry else [])), plan


def rewritten(docs: DataFrame, path: str, old_shard: Column, old: int, **options) -> Plan:
    """Writes the files of the shards that change, with all columns of docs, to path/shard=N; others stay untouched.

    docs may be read from path itself. Columns `shard` and `slot` of docs are replaced.
    """
    placed, plan = resharded(docs, old_shard=old_shard, old=old, carry=True, **options)
    if plan.touched:
        fields = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
        moved = cut(placed.where(F.col("shard").isin(*plan.touched)).select(*fields, "shard", "slot"))
        moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        drop_cut(moved)
        for shard in plan.touched - set(plan.target.values()):  # nothing is left in it, so nothing was written over it
            gone = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
            gone.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).delete(gone, True)
    return plan
