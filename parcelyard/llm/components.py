"""Connected components of a link table by alternating star contractions; the result's label is the least id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.shared import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, component) for every id that a link has; component is the least id it reaches.

    Links form a forest of stars when a round changes nothing. Every round is two aggregations by least neighbour (combined
    before the shuffle, so a hub costs one row for each task) and joins; its table is stored, which cuts the lineage, and
    the one before is deleted. Null ends and links of an id to itself are left out. The result is a stored table, one of
    ``scratch`` if that is given.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    last, before = Scratch(links.sparkSession), None
    edges = last.store(edges)
    while True:
        # Large star: every larger neighbour of u gets the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours get the least of those.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = Scratch(links.sparkSession)
        edges = following.store(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        last.clear()
        last = following
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    labels = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
    out = (scratch or Scratch(links.sparkSession)).store(labels, keep=scratch is None)
    last.clear()
    return out
