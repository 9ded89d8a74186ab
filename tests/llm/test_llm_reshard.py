"""Resharding: least bytes by brute force, and equal texts without ids that fill most of the table."""

import itertools
import random

from pyspark.sql import functions as F

from lodestone.llm import reshard


def cheapest(supply, capacity, cost):
    """The least cost over all ways to ship the supplies, one unit at a time."""
    best = {tuple(capacity): 0}
    for i, n in enumerate(supply):
        reached = {}
        for left, spent in best.items():
            for ways in itertools.product(*(range(min(n, c) + 1) for c in left)):
                if sum(ways) == n:
                    after = tuple(c - w for c, w in zip(left, ways))
                    price = spent + sum(w * cost[i][j] for j, w in enumerate(ways))
                    reached[after] = min(price, reached.get(after, price))
        best = reached
    return min(best.values())


def test_flow_costs_least():
    rng = random.Random(9)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 4) for _ in range(n)]
        capacity = [rng.randint(0, 4) for _ in range(m)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        flow = reshard.min_cost_flow(supply, capacity, cost)
        assert [sum(x) for x in flow] == supply
        assert all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
        assert sum(flow[i][j] * cost[i][j] for i in range(n) for j in range(m)) == cheapest(supply, capacity, cost)


def test_few_bytes_move_when_shards_stay_as_they_are(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    placed, plan = reshard.resharded(docs, shards=4, old_shard=F.pmod(F.col("doc_id"), F.lit(4)), old=4)
    moved = placed.where("shard <> old_shard").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sizes = {r.old_shard: r.s for r in placed.groupBy("old_shard").agg(F.sum("size").alias("s")).collect()}
    fair = sum(sizes.values()) // 4
    assert moved <= sum(max(0, s - fair) for s in sizes.values()) + 4 * 10


def test_equal_texts_without_ids_are_spread(spark):
    schema = "doc_id long, text string"
    rows = [(None, "y" * 999)] * 2000 + [(i, f"short {i}") for i in range(2000)]
    placed, _ = reshard.resharded(spark.createDataFrame(rows, schema))
    found = placed.groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots")).collect()
    total = sum(r["size"] for r in found)
    assert len(found) == 16 and sum(r.n for r in found) == 4000
    assert max(abs(r["size"] - total / 16) for r in found) <= total / 16 / 16
    assert all(r.last == r.n - 1 and r.slots == r.n for r in found)


def test_groups_stay_together_if_asked(spark):
    rows = spark.createDataFrame([(None, "y" * 999)] * 200 + [(i, f"short {i}") for i in range(200)], "doc_id long, text string")
    placed, _ = reshard.resharded(rows, split=None)
    assert placed.where("size = 1000").select("shard").distinct().count() == 1
    assert placed.count() == 400
