"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, materialise


def _to_minimum(edges: DataFrame, own: bool) -> DataFrame:
    """Edges (a, b) hang their b under the least of a and its neighbours; with own, a does so too."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("at", "m").alias("m"))
    joined = edges.join(least, edges.a == least["at"])
    moved = joined.select(F.col("b").alias("x"), F.col("m").alias("y"))
    if own:
        moved = moved.unionByName(least.select(F.col("at").alias("x"), F.col("m").alias("y")))
    return moved.where("x <> y").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes in `links` (a, b), with root the least node of the component.

    The two steps keep the components and end in stars; a path of n nodes takes a number of rounds that grows
    with log n. Each round is a written table, so a lost executor costs one round at most. Self links and
    repeated links are harmless; links with a null end are dropped.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = materialise(ends.distinct(), "links")
    while not _stars(edges):
        # large star: strictly larger neighbours move to the least neighbour
        every = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _larger(every)
        # small star: each node and its smaller neighbours move to the least of them
        down = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        before, edges = edges, materialise(_to_minimum(down, True).select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
        discard(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end hangs on one smaller end, and no smaller end hangs on another."""
    hanging = edges.groupBy("a").agg(F.count("*").alias("n"))
    chained = edges.join(hanging.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return hanging.where("n > 1").select("a").unionByName(chained).limit(1).count() == 0


def _larger(every: DataFrame) -> DataFrame:
    """Large star over edges in both directions: (x, y) for each x that is larger than the node it hangs on."""
    least = every.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("at", "m").alias("m"))
    up = every.where("b > a")
    return up.join(least, up.a == least["at"]).select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
