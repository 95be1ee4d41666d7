"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, spread_join, written


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for each node with an edge, but the least of its component, that least node v.

    edges: (u, v), u > v, of longs. Each round moves edges towards the least node; their number doesn't grow, and the
    rounds grow with the logarithm of the longest path. Each round is a table in the shared folder, and the one before goes.
    A node with very many edges is aggregated before it is shuffled, and its edges are dealt out over tasks when its least
    neighbour is joined.
    """
    edges = written(edges.distinct(), "edges")
    last = _sum(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("rows")).withColumn("m", F.least("u", "m"))
        # large star: a node's larger neighbours go to its least neighbour
        large = spread_join(both.where("v > u"), least, ["u"], "rows", last[0], by="v").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        own = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = spread_join(large, own, ["u"], "rows", last[0], by="v").select(F.explode(pairs).alias("e")).select("e.*").where("u != v").distinct()
        new = written(small, "edges")
        now = _sum(new)
        dropped(edges)
        edges = new
        if now == last:
            break
        last = now
    return edges
