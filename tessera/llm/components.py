"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Rounds after which something must be wrong: the number needed grows with the logarithm of a path's length.
MAX_ROUNDS = 60


def _stars(edges: DataFrame, low: bool) -> DataFrame:
    """One round. ``edges`` has u > v. Large star: every larger neighbour, small star: every smaller one, is linked to the least."""
    both = edges if low else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if low:
        moved = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """No node has two edges up, or one up and one down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): every node of ``edges`` (columns a, b) with the least node it reaches.

    Self links and repeated links do no harm; nulls are not nodes. Each round
    is two aggregations and two joins on staged tables; a node that very many
    links share is combined on the map side when its least neighbour is found,
    and the join that follows can be split by AQE. Stops when every node hangs
    on one other, on which others hang alone; such stars need no round at all.
    """
    work = Workspace(edges.sparkSession, name)
    current = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, last = work.stage(current, "links"), "links"
    for k in range(MAX_ROUNDS):
        if _settled(current):
            break
        large = work.stage(_stars(current, low=False), f"large{k}")
        current = work.stage(_stars(large, low=True), f"small{k}")
        work.drop(last)
        work.drop(f"large{k}")
        last = f"small{k}"
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
