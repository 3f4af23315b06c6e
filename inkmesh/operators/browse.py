"""Browsing: counts, categories, filters, title maps, opening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import ALL_NOTES, has_category, in_category, title_contains


def metadata(notes: DataFrame) -> DataFrame:
    return notes.select("id", "title", "category")


def note_count(notes: DataFrame, selected: str | None = None) -> DataFrame:
    """One row: how many notes the selection has ('' counts '' only, never NULL)."""
    return notes.where(in_category(F.col("category"), selected)).agg(F.count("*").alias("note_count"))


def count_by_category(notes: DataFrame) -> DataFrame:
    return notes.groupBy("category").agg(F.count("*").alias("note_count"))


def categories(notes: DataFrame) -> DataFrame:
    """Distinct non-empty categories, in code-point order."""
    return notes.where(has_category(F.col("category"))).select("category").distinct().orderBy("category")


def category_exists(notes: DataFrame, name: str) -> bool:
    return bool(notes.where(F.col("category") == name).limit(1).count())


def chosen_category(notes: DataFrame, index: int | None, name: str | None) -> str:
    """The category at an index of the list (0 is the sentinel), else the named one if it exists, else the sentinel."""
    if index is not None and index > 0:
        at = categories(notes).offset(index - 1).limit(1).collect()
        if at:
            return at[0]["category"]
    if index == 0 or name is None or not has_name(name):
        return ALL_NOTES
    return name if category_exists(notes, name) else ALL_NOTES


def has_name(name: str) -> bool:
    return name not in ("", ALL_NOTES)


def message_titles(notes: DataFrame, ids: DataFrame, default: str = "the selected note") -> DataFrame:
    """(id, title) for each of ``ids``, as messages name notes: the default for one that does not exist."""
    return ids.select("id").join(notes.select("id", F.col("title").alias("__title"), F.lit(True).alias("__known")), "id", "left").select("id", F.when(F.col("__known"), F.col("__title")).otherwise(default).alias("title"))


def in_selection(notes: DataFrame, selected: str | None) -> DataFrame:
    return notes.where(in_category(F.col("category"), selected))


def search(notes: DataFrame, query: str, without: str | None = None) -> DataFrame:
    """Notes whose title holds the query; ``without``: the current note's id."""
    return notes.where(title_contains(F.col("title"), query) & ~F.col("id").eqNullSafe(F.lit(without)))


def title_first(notes: DataFrame) -> DataFrame:
    """(title, id): the earliest note of each title, as saving looks it up."""
    return notes.groupBy("title").agg(F.min_by("id", "seq").alias("id"))


def title_last(notes: DataFrame) -> DataFrame:
    """(title, id): the latest note of each title, as browsing and ingest look it up."""
    return notes.groupBy("title").agg(F.max_by("id", "seq").alias("id"))


def note(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.where(F.col("id") == note_id).select("id", "title", "content", "category").limit(1)


def note_content(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.where(F.col("id") == note_id).select("content").limit(1)


def id_by_title(notes: DataFrame, title: str) -> DataFrame:
    """The earliest note with exactly this title; no row if there is none."""
    return notes.where(F.col("title") == title).orderBy("seq").limit(1).select("id")


def open_by_title(notes: DataFrame, title: str, selected: str | None = None) -> DataFrame:
    """The latest note of the title within the selection; older ones of that title are hidden."""
    shown = in_selection(notes, selected).where(F.col("title") == title)
    return shown.orderBy(F.desc("seq")).limit(1).select("id", "title", F.coalesce("category", F.lit("")).alias("category"), "content")


def open_by_id(notes: DataFrame, note_id: str, selected: str | None = None) -> DataFrame:
    """Through the title map of the selection: no row for a note outside it or hidden by a later one of its title."""
    shown = in_selection(notes, selected)
    title = shown.where(F.col("id") == note_id).select("title")
    latest = shown.join(title, "title", "left_semi").groupBy("title").agg(F.max_by("id", "seq").alias("id"))
    return shown.join(latest.where(F.col("id") == note_id).select("id"), "id", "left_semi").select("id", "title", F.coalesce("category", F.lit("")).alias("category"), "content")


def browse(notes: DataFrame, selected: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a browse shows: the notes in insertion order, their count, the categories."""
    return metadata(in_selection(notes, selected).orderBy("seq")), note_count(notes, selected), categories(notes)
