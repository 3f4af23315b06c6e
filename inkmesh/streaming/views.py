"""Views kept up to date from a change log: counts, categories, title maps, and the pan and zoom of a session.

A change (seq, id, gone, title, category) puts or deletes a note.  State is
kept for each note, in a table: what it last counted for.  A change gives a *delta*, which
takes the note out of its old category and title (-1) and puts it into the new
ones (+1).  Deltas are appended to a table, a folder for each micro-batch, so a
batch that is run again replaces what it wrote.  A view is a sum over deltas.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkmesh.functions.geometry import zoom_step

CHANGE = "seq long, id string, gone boolean, title string, category string"
DELTA = "id string, title string, category string, place long, delta int"
STATE = "id string, title string, category string, place long, seq long"
#: One batch in so many writes the states of all notes; those between write what they touch.
WHOLE = 16


def steps(changes: DataFrame, before: DataFrame) -> DataFrame:
    """The changes that count, each with the state of its note (title, category, place, seq) after it, and those before them (``old``).

    ``before`` has the state (id, title, category, place, seq) of the notes of ``changes``, place being null for a deleted one.
    A note keeps its place (the ``seq`` that made it) until it is deleted.
    Changes are taken in order of ``seq``; one that is older than what the
    note's state has seen does nothing, nor does a second one of the same ``seq``.
    """
    rows = before.select("*", F.col("place").isNull().alias("gone"), F.lit(True).alias("old")).unionByName(
        changes.select("id", "title", "category", F.col("seq").alias("place"), "seq", "gone", F.lit(False).alias("old"))
    )
    in_order = Window.partitionBy("id").orderBy("seq", F.desc("old"))
    seen = F.max(F.when(F.col("old"), F.col("seq"))).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the state's row comes before all changes that are not older, and negative numbers are older than any note's state
    first = F.coalesce(F.lag("seq").over(in_order) < F.col("seq"), F.lit(True)) & (F.col("seq") >= 0)
    state = F.max(F.col("old").cast("int")).over(Window.partitionBy("id"))
    rows = rows.withColumns({"__first": first, "__seen": seen, "__state": state})
    rows = rows.where(F.col("old") | F.col("__first") & ((F.col("__state") == 0) | F.col("__seen").isNotNull()))
    life = F.sum(F.col("gone").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lives = rows.withColumn("__life", life)
    made = F.min(F.when(~F.col("gone"), F.col("place"))).over(Window.partitionBy("id", "__life"))
    value = lambda c: F.when(~F.col("gone"), F.col(c)).alias(c)
    return lives.withColumn("place", made).select("id", value("title"), value("category"), value("place"), "seq", "old")


def deltas(steps: DataFrame) -> DataFrame:
    """The deltas of ``steps``: each change takes out what its note was before, and puts in what it is then."""
    held, w = F.struct("title", "category", "place"), Window.partitionBy("id").orderBy("seq", F.desc("old"))
    both = steps.withColumns({"__before": F.lag(held).over(w), "__after": held}).where("not old")
    out = F.array(F.struct(F.col("__before").alias("v"), F.lit(-1).alias("delta")), F.struct(F.col("__after").alias("v"), F.lit(1).alias("delta")))
    return both.select("id", F.inline(out)).where("v.place is not null").select("id", "v.title", "v.category", "v.place", "delta")


def keep_views(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that appends the deltas of ``changes`` to the table at ``path``.

    The notes' states lie beside the checkpoint's own tables: each batch writes
    those that it touches, and one in ``WHOLE`` batches those of all notes.
    """
    states = f"{checkpoint}/states"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        whole = number - number % WHOLE
        # batches before this one, from the last whole one on
        earlier = range(max(0, whole - WHOLE if number == whole else whole), number)
        before = spark.createDataFrame([], STATE)
        if earlier:
            kept = spark.read.schema(STATE + ", batch int").option("basePath", states).parquet(*[f"{states}/batch={n}" for n in earlier])
            before = kept.groupBy("id").agg(F.max_by(F.struct("title", "category", "place", "seq"), "batch").alias("s")).select("id", "s.*")
        changed = batch.select("id", "seq", "gone", "title", "category")
        ids = changed.select(F.col("id").alias("__id")).distinct()
        touched = before.join(ids, F.col("id").eqNullSafe(F.col("__id")), "left_semi") if earlier else before
        told = f"{checkpoint}/steps"
        steps(changed, touched).write.mode("overwrite").parquet(told)
        done = spark.read.schema(STATE + ", old boolean").parquet(told)
        deltas(done).write.mode("overwrite").parquet(f"{path}/batch={number}")
        last = done.groupBy("id").agg(F.max_by(F.struct("title", "category", "place", "seq"), F.struct("seq", ~F.col("old"))).alias("s")).select("id", "s.*")
        if number == whole and earlier:
            last = last.unionByName(before.join(ids, F.col("id").eqNullSafe(F.col("__id")), "left_anti"))
        last.write.mode("overwrite").parquet(f"{states}/batch={number}")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DELTA + ", batch int").parquet(path)


def held(found: DataFrame) -> DataFrame:
    """(id, title, category, place) of the notes that the deltas leave."""
    return found.groupBy("id", "title", "category", "place").agg(F.sum("delta").alias("n")).where("n > 0").drop("n")


def live_counts(found: DataFrame) -> DataFrame:
    """(category, note_count), as ``browse.count_by_category`` counts the notes themselves."""
    return found.groupBy("category").agg(F.sum("delta").cast("long").alias("note_count")).where("note_count > 0")


def live_titles(found: DataFrame) -> DataFrame:
    """(title, id): the latest note of each title, as ``browse.title_last`` finds it."""
    return held(found).groupBy("title").agg(F.max_by("id", "place").alias("id"))


VIEW = "session string, zoom double, offset_x double, offset_y double, seq long"


def session_views(events: DataFrame, zoom: float = 1.0, offset_x: float = 0.0, offset_y: float = 0.0) -> DataFrame:
    """Streaming: the view of each session after each micro-batch (update mode); state is one view a session.

    ``events`` has session, seq, kind ('pan' or 'wheel'), dx, dy, wheel, x, y; events of a session come in order of seq.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        z, ox, oy, seen = state.get if state.exists else (zoom, offset_x, offset_y, -1)
        for e in pd.concat(list(parts)).sort_values("seq").to_dict("records"):
            if e["seq"] <= seen:
                continue
            seen = e["seq"]
            if e["kind"] == "pan":
                ox, oy = ox + e["dx"] / z, oy + e["dy"] / z
            else:
                z, ox, oy = zoom_step(z, ox, oy, e["wheel"], e["x"], e["y"])
        state.update((z, ox, oy, seen))
        yield pd.DataFrame([(key[0], z, ox, oy, seen)], columns=["session", "zoom", "offset_x", "offset_y", "seq"])

    return events.groupBy("session").applyInPandasWithState(step, VIEW, "z double, x double, y double, seq long", "update", "NoTimeout")
