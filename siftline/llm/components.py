"""Connected components of a distributed edge table, by alternating large and small stars.

Each round points every vertex at the least one it has heard of; rounds are logarithmic in the longest path. Every step
is an aggregation by vertex, summed before its shuffle, and an equi-join; edges never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges that a task works on, about; smaller tables have four tasks. Edges of a vertex, and a part of all edges, above which
#: its row is broadcast: no more than twice HEAVY_PART vertices can have so many.
EDGES_PER_TASK = 200_000
HEAVY, HEAVY_PART = 1_000_000, 1000


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _meet(edges: DataFrame, rows: DataFrame, key: str, total: int) -> DataFrame:
    """edges joined with one row (key, m, d) per vertex, d its edges; hubs don't gather their edges in one task."""
    if total <= HEAVY:
        return edges.join(rows.drop("d"), key)
    hub = F.col("d") > max(HEAVY, total // HEAVY_PART)
    hubs = F.broadcast(rows.where(hub).drop("d"))
    return edges.join(hubs, key).unionByName(edges.join(hubs, key, "left_anti").join(rows.where(~hub).drop("d"), key))


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a and b, long. Returns (id, component) for every id that an edge names.

    component is the least id that can be reached. Self-loops are allowed and repeated edges harmless; nulls are
    ignored; an empty table gives an empty one.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = cut(pairs)
    # Tasks by size: a round has many shuffles, and each task of a small table would leave files in every one of them.
    tasks = max(4, pairs.count() // EDGES_PER_TASK)
    small_ = lambda df: df.coalesce(tasks)
    ids = small_(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    now = cut(small_(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    last, ids = None, cut(ids)
    while (mark := _mark(now)) != last:
        last = mark
        # Large star: neighbours greater than v move to the least of v and its neighbours.
        both = now.union(now.select("b", "a")).toDF("v", "n")
        least = both.groupBy("v").agg(F.least(F.min("n"), F.first("v")).alias("m"), F.count("*").alias("d"))
        large = small_(_meet(both.where("n > v"), least, "v", mark[0])).select(F.col("n").alias("a"), F.col("m").alias("b"))
        large = small_(large.union(small_(least.where("m < v").select("v", "m"))).where("a <> b").distinct())
        # Small star: v and its lesser neighbours move to the least of these.
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d"))
        small = small_(_meet(large, down, "a", mark[0])).select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_(down.select("a", "m")))
        now = cut(small_(small.where("a <> b").distinct()))
    final = small_(now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")))
    return small_(ids.join(final, "id", "left")).select("id", F.coalesce("component", "id").alias("component"))
