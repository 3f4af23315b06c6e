"""Places for the nodes of a selection: a layered drawing made by joins.

Links that run in a circle are condensed first; a node's rank is the longest
chain of links that leads to its circle.  Within a rank, nodes are ordered by
the medians of their neighbours' places, odd and even ranks by turns, in a fixed
number of sweeps.  Ranks
are rows of the drawing, and connected components stand side by side.  All
steps are joins and sums over the tables of nodes and links: each round's state
is written, and the driver sees a count.  The number of rounds follows from the
longest chain.  The drawing is the same for the same tables, however they are dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.geometry import DEFAULT_HEIGHT, DEFAULT_WIDTH
from inkmesh.operators.components import connected
from inkmesh.operators.ordinals import numbered, running
from inkmesh.sources.scratch import scratch, written

#: Space between nodes, and sweeps of the order within ranks.
GAP, SWEEPS = 25.0, 4


def _until_still(state: DataFrame, step, folder: str, name: str, measure) -> DataFrame:
    """``step`` applied to ``state``, written each time, until ``measure`` (an aggregate) stays."""
    seen, round_ = state.agg(measure).first()[0], 0
    while True:
        state = written(step(state), folder, f"{name}{round_}")
        now = state.agg(measure).first()[0]
        if now == seen:
            return state
        seen, round_ = now, round_ + 1


def _in_circles(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """The edges (a, b) that lie between circles: without those whose start has no edge in or whose end has none out."""

    def peel(e: DataFrame) -> DataFrame:
        starts, ends = e.select(F.col("a").alias("b")).distinct(), e.select(F.col("b").alias("a")).distinct()
        return e.join(starts, "b", "left_semi").join(ends, "a", "left_semi").select("a", "b")

    return _until_still(edges, peel, folder, name, F.count("*"))


def circles(edges: DataFrame, folder: str) -> DataFrame:
    """(node, head) of the nodes of ``edges`` (a, b) that lie on a circle; the head is the circle's largest node.

    Each node takes the largest node that leads to it as its colour; the nodes
    that lead back to the colour's own node, within the colour, are its circle.
    """
    left, found, k = _in_circles(edges.where("a <> b").distinct(), folder, "peel0_"), None, 0
    while left.limit(1).count():
        nodes = written(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), folder, f"nodes{k}")

        def lead(colours: DataFrame) -> DataFrame:
            told = left.join(colours.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "colour")  # noqa: B023
            return colours.unionByName(told).groupBy("node").agg(F.max("colour").alias("colour"))

        colours = _until_still(nodes.withColumn("colour", F.col("node")), lead, folder, f"colour{k}_", F.sum("colour"))
        own = left.join(colours.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb")
        own = written(own.select("a", "b", F.col("ca").alias("colour")), folder, f"own{k}")

        def back(reached: DataFrame) -> DataFrame:
            told = own.join(reached.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "colour")  # noqa: B023
            return reached.unionByName(told).distinct()

        circle = _until_still(colours.where("node = colour"), back, folder, f"back{k}_", F.count("*"))
        circle = circle.select("node", F.col("colour").alias("head"))
        found = circle if found is None else found.unionByName(circle)
        rest = left.join(circle.select(F.col("node").alias("a")), "a", "left_anti").join(circle.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
        k += 1
        left = _in_circles(written(rest, folder, f"rest{k}"), folder, f"peel{k}_")
    return nodes_of_none(edges) if found is None else found


def nodes_of_none(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("a").alias("head")).limit(0)


def ranks(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """(node, rank): the longest chain of links to the node, circles taken as one."""
    heads = nodes.join(circles(edges, f"{folder}/circles"), "node", "left").select("node", F.coalesce("head", "node").alias("head"))
    heads = written(heads, folder, "heads")
    of = lambda end: heads.select(F.col("node").alias(end), F.col("head").alias(f"{end}_head"))
    links = edges.join(of("a"), "a").join(of("b"), "b").where("a_head <> b_head").select(F.col("a_head").alias("a"), F.col("b_head").alias("b")).distinct()
    links = written(links, folder, "condensed")

    def relax(state: DataFrame) -> DataFrame:
        told = links.join(state.withColumnRenamed("head", "a"), "a").select(F.col("b").alias("head"), (F.col("rank") + 1).alias("rank"))
        return state.unionByName(told).groupBy("head").agg(F.max("rank").alias("rank"))

    start = heads.select("head").distinct().withColumn("rank", F.lit(0))
    return heads.join(_until_still(start, relax, folder, "rank", F.sum("rank")), "head").select("node", "rank")


def _ordered(nodes: DataFrame, folder: str) -> DataFrame:
    """Adds ``pos``, the place within (component, rank), by ``want`` and then node; no rank goes through one window."""
    rows = numbered(nodes, ["component", "rank", "want", "node"], "__n", folder=folder)
    first = rows.groupBy("component", "rank").agg(F.min("__n").alias("__first"))
    return rows.join(first, ["component", "rank"]).withColumn("pos", (F.col("__n") - F.col("__first")).cast("double")).drop("__n", "__first", "want")


def place_nodes(nodes: DataFrame, links: DataFrame, sweeps: int = SWEEPS, gap: float = GAP, folder: str | None = None) -> DataFrame:
    """(id, component, rank, pos, x, y, w, h) for nodes (id, and w and h if known) and links; links of other nodes drop out.

    x and y are centres.  Nodes of a rank do not overlap, nor do ranks, nor components.
    """
    folder = folder or scratch(nodes.sparkSession)
    size = lambda c, default: F.coalesce(F.col(c), F.lit(default)).cast("double") if c in nodes.columns else F.lit(default)
    # dealing into ranges reads its input twice, and sizes may be costly to make
    sizes = written(nodes.select("id", size("w", DEFAULT_WIDTH).alias("w"), size("h", DEFAULT_HEIGHT).alias("h")), folder, "sizes")
    known = written(numbered(sizes, ["id"], "node", folder=f"{folder}/numbers"), folder, "known")
    at = lambda end, n: known.select(F.col("id").alias(end), F.col("node").alias(n))
    edges = links.join(at("source_note_id", "a"), "source_note_id").join(at("target_note_id", "b"), "target_note_id").where("a <> b").select("a", "b").distinct()
    edges = written(edges, folder, "links")
    parts = connected(edges.unionByName(known.select(F.col("node").alias("a"), F.col("node").alias("b"))), f"{folder}/components")
    drawn = known.select("node").join(parts, "node").join(ranks(known.select("node"), edges, folder), "node")
    drawn = written(_ordered(drawn.withColumn("want", F.col("node").cast("double")), f"{folder}/order"), folder, "order0")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for k in range(sweeps):
        met = both.join(drawn.select(F.col("node").alias("b"), F.col("pos").alias("p")), "b").groupBy(F.col("a").alias("node")).agg(F.percentile("p", 0.5).alias("median"))
        turn = F.col("rank") % 2 == (k + 1) % 2  # odd and even ranks by turns, else two ranks change sides together
        wanted = drawn.join(met, "node", "left").select("node", "component", "rank", F.when(turn, F.coalesce("median", "pos")).otherwise(F.col("pos")).alias("want"))
        drawn = written(_ordered(wanted, f"{folder}/order{k}"), folder, f"order{k + 1}")
    full = written(drawn.join(known, "node"), folder, "drawn")
    # right edges within a rank, and of the components side by side; both by running totals over all nodes
    ends = running(full.withColumn("__wide", F.col("w") + gap), ["component", "rank", "pos"], "__wide", "__end", folder=f"{folder}/widths")
    ends = written(ends, folder, "ends")
    rows = ends.groupBy("component", "rank").agg(F.min(F.col("__end") - F.col("__wide")).alias("__start"), F.sum("__wide").alias("__row"), F.max("h").alias("__tall"))
    rows = written(rows, folder, "rows")
    boxes = running(rows.groupBy("component").agg(F.max("__row").alias("__box")), ["component"], "__box", "__right", folder=f"{folder}/boxes")
    tops = running(rows.groupBy("rank").agg((F.max("__tall") + gap).alias("__step")), ["rank"], "__step", "__bottom", folder=f"{folder}/tops")
    placed = ends.join(rows.drop("__tall"), ["component", "rank"]).join(boxes, "component").join(tops, "rank")
    x = F.col("__right") - F.col("__box") + (F.col("__box") - F.col("__row")) / 2 + F.col("__end") - F.col("__start") - F.col("__wide") / 2
    return placed.select("id", "component", "rank", F.col("pos").cast("long").alias("pos"), x.alias("x"), (F.col("__bottom") - F.col("__step") / 2).alias("y"), "w", "h")
