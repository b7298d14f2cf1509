"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.small import written


def _least(edges: DataFrame) -> DataFrame:
    """``(u, v, m)``: every neighbour of u with the least of them and of u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    near = _least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    own = near.select("u", F.col("m").alias("v"))
    return near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id in ``edges (u, v)``: the least id that can be reached.

    Each round is a few joins on the edges, whose number never grows; the rounds needed grow with
    the logarithm of the size. Every round is written to the shared work folder, which ends the
    lineage. Only a count and a checksum come to the driver. No edges, or null ones, give no rows.
    """
    edges = written(edges.where("u is not null and v is not null and u != v").select("u", "v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    before = None
    for _ in range(most_rounds):
        edges = written(small_star(large_star(edges)), "edges")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionByName(roots).select(F.col("u").alias("id"), F.col("v").alias("component"))
