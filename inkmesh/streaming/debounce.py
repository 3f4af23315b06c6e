"""Debounce: act once per quiet period (S2), in batch and in Structured Streaming.

A burst is a run of events of one key in which no two neighbours are ``gap``
or more apart; what is acted on is the burst's last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce_batch(events: DataFrame, gap: str = "1 hour", key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The events after which nothing of the same key comes for ``gap``."""
    w = Window.partitionBy(key).orderBy(ts, order)
    later = F.lead(ts).over(w)
    return events.withColumn("__next", later).where(F.col("__next").isNull() | (F.col("__next") - F.col(ts) >= F.expr(f"interval {gap}"))).drop("__next")


def debounce_stream(events: DataFrame, gap: str = "1 hour", delay: str = "1 hour", key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Streaming form: session windows with a watermark; one row per closed burst."""
    timed = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", delay)
    burst = timed.groupBy(F.session_window("__t", gap), F.col(key)).agg(F.max(F.struct(F.col("__t"), F.col(order))).alias("__last"), F.count("*").alias("n"))
    return burst.select(key, F.col(f"__last.{order}").alias(order), F.col("__last.__t").alias(ts), "n")


def refresh_views(changes: DataFrame, refresh, checkpoint: str):
    """Calls ``refresh(batch, batch_id)`` for each micro-batch of a change log (S1, S4); returns the query."""
    return changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).start()
