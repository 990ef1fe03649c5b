"""Connected components of an edge table by alternating large-star and small-star
steps. Every step is a join and a grouped minimum; nothing of the graph reaches
the driver but a count of the edges that changed, and each round is written to
the shared folder. Edges of one hot node are spread by Spark's skew join, and
minima are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u > v). Large star: link every larger neighbour of a node to the
    smallest one of its neighbourhood. Small star: the same for the smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    j = both.join(least, F.col("u") == F.col("c"))
    if large:
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("c").alias("u"), F.col("m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns u and v of one orderable type. Returns (node, component)
    for every node of an edge that isn't the smallest of its component; component is
    that smallest node. Self-links, repeats and null ends are ignored."""
    e = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    e = written(e, "edges")
    while True:
        step = written(_star(e, True), "large-star")
        new = written(_star(step, False), "small-star")
        release(step)
        # done when both steps leave the stars as they are
        if new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty():
            release(e)
            return new.select(F.col("u").alias("node"), F.col("v").alias("component"))
        release(e)
        e = new
