"""Connected components of an edge table, by alternating large and small stars.

Nodes are longs. A round rewires each node's larger neighbours, then its smaller ones,
to the least node it knows; both keep components as they are, and the edges end as one
star around the least node of each component, after about log(n) rounds. Neighbour
minima are partial aggregates and come back by an equi-join whose hub keys AQE can
split, so no neighbourhood is ever gathered. Each round is cut by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, delete_path, scratch_dir


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node of an edge; component is the least node reachable.

    Self-edges, repeated edges and either direction are allowed; rows with a null end
    are no edges. Nodes of self-edges alone are not returned.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v").distinct()
    was, mark = None, None
    for _ in range(max_rounds):
        where = scratch_dir(spark, "stars")
        now = cut(_small(_large(now)), "stars", where)
        if was is not None:
            delete_path(spark, was)
        was = where
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
