"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marl.llm import common

#: The stars are proven to end in O(log^2 n) rounds; this is far beyond any input that fits a cluster.
MAX_ROUNDS = 200


def _with_least(edges: DataFrame, own_too: bool, total: int) -> DataFrame:
    """Edges (u, v) with m, the least node around u. Hubs get it by broadcast: a hub is on more than an even share
    of `total` edges, so there are fewer hubs than partitions, and no hub's edges meet in one task.
    """
    n = common.partitions(edges.sparkSession)
    around = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    if own_too:
        around = around.withColumn("m", F.least("u", "m"))
    many = total // n + 1
    hubs = around.where(F.col("degree") >= many).select("u", F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    at_hubs = marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    others = around.where(F.col("degree") < many).select("u", "m")
    return at_hubs.unionByName(marked.where("hub_m is null").select("u", "v").join(others.hint("merge"), "u"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, True, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    known = _with_least(down, False, total)
    return known.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the least node of its component and maps to itself.

    Loops and repeated edges are harmless; no edges give no rows.
    """
    now = common.materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "stars")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        wide = common.materialise(_large_star(now, state[0]), "stars")
        now = common.materialise(_small_star(wide, state[0]), "stars")
        if (after := _state(now)) == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
