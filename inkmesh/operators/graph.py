"""Link reads and the graph view's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.geometry import arrow_heads
from inkmesh.functions.text import in_category


def both_ways(links: DataFrame) -> DataFrame:
    """(id, neighbor), undirected and distinct; a self-link gives the note itself once."""
    s, t = F.col("source_note_id"), F.col("target_note_id")
    pairs = F.array(F.struct(s.alias("id"), t.alias("neighbor")), F.struct(t.alias("id"), s.alias("neighbor")))
    return links.select(F.explode(pairs).alias("p")).select("p.id", "p.neighbor").distinct()


def neighbors_of(links: DataFrame, note_id: str) -> DataFrame:
    """Neighbours of one note: the filter comes before the distinct, so it reaches the scan."""
    s, t = F.col("source_note_id"), F.col("target_note_id")
    touching = links.where((s == note_id) | (t == note_id))
    return touching.select(F.explode(F.array_compact(F.array(F.when(s == note_id, t), F.when(t == note_id, s)))).alias("neighbor")).distinct()


def linked_titles(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, neighbor, title) of all notes; links to missing notes drop out."""
    titles = notes.select(F.col("id").alias("neighbor"), "title")
    return both_ways(links).join(titles, "neighbor").select("id", "neighbor", "title")


def linked_titles_of(notes: DataFrame, links: DataFrame, note_id: str) -> DataFrame:
    return neighbors_of(links, note_id).join(notes.select(F.col("id").alias("neighbor"), "title"), "neighbor").select("neighbor", "title")


def within(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with both ends among ``ids`` (column id)."""
    return links.join(ids.select(F.col("id").alias("source_note_id")), "source_note_id", "left_semi").join(ids.select(F.col("id").alias("target_note_id")), "target_note_id", "left_semi").select("source_note_id", "target_note_id")


def induced_subgraph(notes: DataFrame, links: DataFrame, selected: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the selection, and the links among them."""
    nodes = notes.where(in_category(F.col("category"), selected))
    return nodes.select("id", "title", "category", "seq"), within(links, nodes)


def strict(links: DataFrame) -> DataFrame:
    """Parallel links collapse; the two directions stay distinct."""
    return links.dropDuplicates(["source_note_id", "target_note_id"])


def view_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: number of notes and of links shown."""
    return nodes.agg(F.count("*").alias("notes")).join(F.broadcast(links.agg(F.count("*").alias("links"))), F.lit(True))


def placed_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with the places of both ends; links of nodes that are not placed drop out."""
    at = lambda end, n: nodes.select(F.col("id").alias(end), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return links.join(at("source_note_id", 1), "source_note_id").join(at("target_note_id", 2), "target_note_id").select("source_note_id", "target_note_id", "x1", "y1", "x2", "y2")


def link_arrows(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return arrow_heads(placed_links(nodes, links))


def resolve(wanted: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_note_id, title) against a title map (title, id): found links, and what was not found."""
    found = wanted.join(titles.select("title", F.col("id").alias("target_note_id")), "title").select("source_note_id", "target_note_id")
    return found, wanted.join(titles, "title", "left_anti").select("source_note_id", "title")
