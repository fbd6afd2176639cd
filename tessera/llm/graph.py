"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, root long)``, root the smallest node reachable.

    Nodes without an edge do not appear.  Null ends and self loops are ignored, repeated edges
    harmless; an empty table gives an empty result.  Each round hooks every node to the smallest
    node next to it (two aggregations with map-side combining and two equi joins).  The joins deal
    out the edges by node; a hub's edges are split by the skew join of adaptive execution, and after
    one round a hub is no node's neighbour but its members' root.  Rounds grow with the logarithm of
    the longest chain.  Every round is a table in the shared folder; the one before it is dropped.
    """
    scratch = scratch or Scratch(spark, "graph")
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = scratch.table(edges.where("a is not null and b is not null and a <> b").select(hi.alias("u"), lo.alias("v")).distinct(), "edges-0")
    mark, k = _mark(now), 0
    while mark[0]:
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.table(sides.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large-{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"edges-{k + 1}")
        scratch.drop(f"large-{k}")
        scratch.drop(f"edges-{k}")
        now, k, before, mark = after, k + 1, mark, _mark(after)
        if mark == before:
            break
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"))))
    return now.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.root").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
