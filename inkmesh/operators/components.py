"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.sources.scratch import scratch, written

#: More rounds than any graph that fits a cluster takes (their number grows with the logarithm of the largest component).
ROUNDS = 100


def _re_tied(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) tied to the least node next to u: the larger neighbours of u (``large``), or u and its smaller neighbours.

    One shuffle serves both the minimum and the join with it.
    """
    if large:
        edges = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    at_u = edges.repartition("u")
    met = at_u.join(at_u.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")


def connected(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b, whole numbers): the least node of each component.

    A node tied to itself only is its own component.  Each round's edges are
    written; the driver sees a count and a sum for each.
    """
    folder = folder or scratch(edges.sparkSession)
    ends = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), folder, "edges")
    state, seen = ends.where("u <> v").distinct(), None
    for step in range(ROUNDS):
        state = written(_re_tied(_re_tied(state, True), False).distinct(), folder, f"round{step}")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    tied = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = ends.select(F.col("v").alias("node")).distinct().join(tied, "node", "left_anti").withColumn("component", F.col("node"))
    return tied.unionByName(alone)
