"""Notes, links and other inputs derived from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.functions.text import in_category, sanitize_title


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a note; its language is the category."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), sanitize_title(F.col("text")).alias("title"), F.col("text").alias("content"), F.col("lang").alias("category"), F.col("doc_id").alias("seq"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two links a note, by a rule: d to (7d+3) mod n and to (13d+5) mod n."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count("*").alias("n"))
    rows = d.join(F.broadcast(n), F.lit(True))
    ends = F.array(((7 * F.col("doc_id") + 3) % F.col("n")).cast("string"), ((13 * F.col("doc_id") + 5) % F.col("n")).cast("string"))
    return rows.select(F.col("doc_id").cast("string").alias("source_note_id"), F.explode(ends).alias("target_note_id")).distinct()


def nodes(spark: SparkSession, sf_dir: str, selected: str | None = None) -> DataFrame:
    """Notes (of a selection) with places and sizes by a rule."""
    i = F.col("seq")
    return notes(spark, sf_dir).where(in_category(F.col("category"), selected)).select(
        "id", "title", "seq", (7919 * i % 1201).cast("double").alias("x"), (104729 * i % 809).cast("double").alias("y"), (F.length("title") % 90 + 10).cast("double").alias("w"), F.lit(20.0).alias("h")
    )


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "value", F.col("event_id").alias("seq"))
