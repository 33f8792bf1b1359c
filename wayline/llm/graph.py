"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import common


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (u, v), u != v, total of them. Minima come from a pre-aggregated group-by and a join in which the edges of a hot node are dealt over several tasks."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size")
    joined = common.join_groups(both, least, ["u"], 2 * total, "v")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable. edges: u, v of one ordered type, no nulls."""
    edges = common.stored(edges.where("u != v").select("u", "v").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    before = mark(edges)
    while before[0]:
        old, edges = edges, common.stored(_star(_star(edges, True, before[0]), False, before[0]), "edges")
        common.drop(old)
        after = mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
