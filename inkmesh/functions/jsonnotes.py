"""Replies of a text generator to note records (operators J1-J4, L5).

Strict JSON is the one step that Spark's parsers cannot do (they accept single
quotes and text after the value), so an Arrow UDF parses; what follows is native.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They decide results.
FENCE_OPEN, FENCE_CLOSE = "```json", "```"
DROP_FRONT, DROP_BACK = 8, 4
DEFAULT_TITLE, DEFAULT_CONTENT, DEFAULT_CATEGORY = "Untitled Note", "", "AI Generated"

REPLY = "status string, notes array<struct<title: string, content: string, general_title: string, connections: array<string>>>"
_NOTE = pa.struct([("title", pa.string()), ("content", pa.string()), ("general_title", pa.string()), ("connections", pa.list_(pa.string()))])


def loads(reply: str | None):
    """The reply's JSON value; tried again inside a code fence; None if neither is JSON."""
    if reply is None:
        return None
    candidates = [reply]
    if reply.startswith(FENCE_OPEN) and reply.endswith(FENCE_CLOSE):
        candidates.append(reply[DROP_FRONT : len(reply) - DROP_BACK])
    for text in candidates:
        try:
            return json.loads(text)
        except ValueError:
            continue
    return None


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


def read_reply(reply: str | None) -> tuple[str, list[dict]]:
    """``ok`` with notes, ``empty`` (nothing usable) or ``error`` (a value of the wrong shape).

    Defaults stand for missing keys only; an explicit null stays null.  Null
    connections, a connection that is no string, or a note that is no object
    spoil the whole reply.
    """
    value = loads(reply)
    if not value:
        return "empty", []
    items = value if isinstance(value, list) else list(value) if isinstance(value, (dict, str)) else None
    if items is None:
        return "error", []
    notes = []
    for item in items:
        if not isinstance(item, dict):
            return "error", []
        links = item.get("connections", [])
        if not isinstance(links, (list, str, dict)) or not all(isinstance(x, str) for x in links):
            return "error", []
        notes.append(
            {
                "title": _text(item.get("title", DEFAULT_TITLE)),
                "content": _text(item.get("content", DEFAULT_CONTENT)),
                "general_title": _text(item.get("general_title", DEFAULT_CATEGORY)),
                "connections": list(links),
            }
        )
    return "ok", notes


def parse_reply(reply: Column) -> Column:
    """Struct of status and notes."""

    @F.arrow_udf(REPLY)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for replies in batches:
            rows = [read_reply(r) for r in replies.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([s for s, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.list_(_NOTE))], names=["status", "notes"])

    return parse(reply)


def generated_notes(replies: DataFrame, reply: str = "reply", batch_id: str = "batch_id") -> DataFrame:
    """One row per note of the replies that are ``ok``: the GENERATED schema."""
    parsed = replies.select(F.col(batch_id).cast("string").alias("batch_id"), parse_reply(F.col(reply)).alias("r"))
    return parsed.where("r.status = 'ok'").select("batch_id", F.posexplode("r.notes").alias("pos", "n")).select("batch_id", "pos", "n.title", "n.content", "n.general_title", "n.connections")


def reply_status(replies: DataFrame, reply: str = "reply", batch_id: str = "batch_id") -> DataFrame:
    return replies.select(F.col(batch_id).cast("string").alias("batch_id"), parse_reply(F.col(reply))["status"].alias("status"))


def json_number(text: Column, key: str) -> Column:
    """A whole number under a key of a JSON object (native; for machine-written JSON)."""
    return F.get_json_object(text, f"$.{key}").try_cast("long")
