"""Batch ingest: documents to text, to generated notes, to notes and links.

The text generator is injected (a function from prompts to replies, called
once per Arrow batch); ids and the time are arguments, so a plan gives the
same rows whenever it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.jsonnotes import generated_notes
from inkmesh.functions.text import note_text, sanitize_title
from inkmesh.operators.asof import last_before
from inkmesh.operators.browse import title_last
from inkmesh.operators.ordinals import numbered
from inkmesh.operators.store import clashing_ids
from inkmesh.sources.scratch import scratch, written

PROMPT = (
    "Read the text below and break it into small notes, one idea each. Answer with a JSON array and nothing else. "
    'Each element has "general_title" (the subject of the whole text), "title", "content" (Markdown) and "connections" (titles of other notes in your answer). Text:\n'
)


def prompts(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("prompt", F.concat(F.lit(PROMPT), F.col(text)))


def generate(texts: DataFrame, generator: Callable[[list[str]], list[str | None]], id_column: str = "path", text: str = "text") -> DataFrame:
    """(batch_id, reply) for each non-empty text; a failing generator gives null replies."""
    ready = prompts(texts.where(F.coalesce(F.col(text), F.lit("")) != ""), text)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            try:
                yield pa.array(generator(part.to_pylist()), pa.string())
            except Exception:  # noqa: BLE001  a remote failure is an empty reply
                yield pa.nulls(len(part), pa.string())

    return ready.select(F.col(id_column).alias("batch_id"), run("prompt").alias("reply"))


def new_notes(generated: DataFrame, note_id: Column, ts: Column) -> DataFrame:
    """Generated notes as rows to insert: every one is inserted, titles may repeat or be empty."""
    content = note_text(F.col("title"), F.col("content"))
    return generated.select(note_id.alias("id"), sanitize_title(content).alias("title"), content.alias("content"), F.col("general_title").alias("category"), ts.alias("ts"), "batch_id", *[c for c in ("batch_no",) if c in generated.columns], "pos", "connections")


def with_batch_numbers(fresh: DataFrame, folder: str | None = None) -> DataFrame:
    """``fresh`` with ``batch_no``, the place of its batch among the runs; where it is not given, batches run in order of their ids."""
    if "batch_no" in fresh.columns:
        return fresh
    batches = numbered(fresh.select("batch_id").distinct(), ["batch_id"], "batch_no", folder=folder)
    return fresh.join(batches, "batch_id")


def title_map(existing: DataFrame, fresh: DataFrame, asked: DataFrame, folder: str | None = None) -> DataFrame:
    """``asked`` (batch_no, title, any more) with ``id``, the note that the batch finds under the title, or null.

    A batch sees what runs before it left: the latest note of a title in its own
    batch, else in the batches before it, else of the existing ones.  Titles are
    looked up as of the batch, so nothing is multiplied by the batches.
    """
    ours = fresh.groupBy("title", "batch_no").agg(F.max_by("id", "pos").alias("id")).select("title", F.col("batch_no").cast("long").alias("batch_no"), "id")
    before = title_last(existing).select("title", F.lit(-1).cast("long").alias("batch_no"), "id")
    return last_before(asked, before.unionByName(ours), ["title"], "batch_no", ["id"], inclusive=True, folder=folder)


def new_links(notes: DataFrame, fresh: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, unresolved) of the connections of new notes; self-links are kept, repeats collapse.

    ``fresh`` has ``batch_no`` from 0 on (see ``with_batch_numbers``).
    """
    folder = folder or scratch(notes.sparkSession)
    fresh = with_batch_numbers(fresh, f"{folder}/batches")
    wanted = fresh.select("batch_id", "batch_no", F.col("id").alias("source_note_id"), F.explode("connections").alias("raw"))
    wanted = wanted.select("batch_id", "batch_no", "source_note_id", sanitize_title(F.col("raw")).alias("title"))
    found = written(title_map(notes, fresh, wanted, f"{folder}/titles"), folder, "found")
    links = found.where("id is not null").select("source_note_id", F.col("id").alias("target_note_id")).distinct()
    return links, found.where("id is null").select("batch_id", "source_note_id", "title")


def placed(notes: DataFrame, fresh: DataFrame, folder: str | None = None) -> DataFrame:
    """``fresh`` as rows of the note table, numbered without gaps after the store's last, in order of batch and place."""
    folder = folder or scratch(notes.sparkSession)
    last = notes.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    rows = numbered(with_batch_numbers(fresh, f"{folder}/batches"), ["batch_no", "pos"], "seq", start=last + 1, folder=f"{folder}/places")
    return rows.select("id", "title", "content", "category", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.col("seq").cast("long").alias("seq"))


def ingest(notes: DataFrame, links: DataFrame, replies: DataFrame, note_id: Column, ts: Column, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, links, unresolved) after the replies (batch_id, reply, and batch_no for the order of the runs); one commit publishes both tables.

    All or nothing: an id that exists or occurs twice raises.
    """
    folder = folder or scratch(notes.sparkSession)
    generated = generated_notes(replies)
    if "batch_no" in replies.columns:
        generated = generated.join(replies.select(F.col("batch_id").cast("string").alias("batch_id"), F.col("batch_no").cast("long").alias("batch_no")).distinct(), "batch_id")
    fresh = new_notes(generated, note_id, ts)
    fresh = written(with_batch_numbers(fresh, f"{folder}/batches"), folder, "fresh")
    if clashing_ids(notes, fresh).limit(1).count():
        raise ValueError("a note with this id exists")
    added, unresolved = new_links(notes, fresh, folder)
    return notes.unionByName(placed(notes, fresh, folder)), links.unionByName(added).distinct(), unresolved
