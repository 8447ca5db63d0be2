"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """id, root (the least id of its component) for each vertex of edges(a, b), which need no order and may repeat.

    In each round every vertex goes to the neighbour, or itself, that a hash of the round puts first, and one step further; the
    edges between what is left are all that the next round sees. A hash that changes leaves about a third of the vertices of
    any shape, so that rounds grow with the logarithm of the vertices, not with the longest path. Only whether edges are
    left comes to the driver.
    """
    left = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found, turn = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("at")), 0
    while left.limit(1).count():
        first = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        near = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = near.groupBy(F.col("a").alias("v")).agg(F.min(first("b")).alias("best"))
        step = cut_lineage(step.select("v", F.least(first("v"), F.col("best"))["id"].alias("to")))
        further = step.select(F.col("v").alias("to"), F.col("to").alias("end"))
        step = cut_lineage(step.join(further, "to").select("v", "end"))
        found = cut_lineage(found.join(step, F.col("at") == F.col("v"), "left").select("id", F.coalesce("end", "at").alias("at")))
        moved = left.join(step.select(F.col("v").alias("a"), F.col("end").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("end").alias("y")), "b")
        left, turn = cut_lineage(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()), turn + 1
    names = found.groupBy("at").agg(F.min("id").alias("root"))
    return found.join(names, "at").select("id", "root")
