"""Connected components of an edge table, by alternating star contraction.

Each round is two aggregates and two joins over the edge table; the edges
are rewritten as a stage table in the shared checkpoint folder every round,
so lineage stays short and a lost executor costs one round at most.  Only
one row (count and checksum) reaches the driver per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import stage


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns u, v of long): the
    label is the smallest node of its component.  Loops and repeated edges
    are allowed, an empty table gives an empty result, null ends are ignored.
    """
    e = (edges.filter(F.col("u") != F.col("v"))
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = stage(e, "edges")
    seen = _mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = stage(small, "edges")
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct())
