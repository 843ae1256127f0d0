"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum (combined before its shuffle) and a join, cut
by a written table, so nothing grows in one task or on the driver and a lost
executor costs at most one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component: least id reachable) for every id in ``edges``; loops and nulls are ignored."""
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = written(e, "edges")
    seen = _state(e)
    if not seen[0]:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        e0 = e
        # large star: neighbours above u go to the least neighbour of u
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u, go to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select("v", "m").where("v != m").union(least).toDF("u", "v").distinct()
        e = written(e, "edges")
        release(e0)
        now = _state(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(e.select("v", "v")).distinct()
