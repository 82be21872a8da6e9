"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its larger (or not larger) neighbours to its smallest neighbour.

    The smallest neighbour comes from an aggregate and goes back by an equi-join, so the
    neighbours of a hub are never held in one task.
    """
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    )
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v: long), root the smallest node it reaches.

    Rounds grow with the logarithm of the largest component, and go on until nothing
    changes. No edges give no rows; repeated edges and loops change nothing.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, mark = scratch.table(edges, f"{name}-0"), None
    for k in count(1):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        nxt = scratch.table(_star(_star(edges, True), False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        edges = nxt
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
