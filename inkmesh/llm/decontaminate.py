"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark item yields the windows of ``window`` consecutive words (an
item with fewer words is one shorter window).  The windows of one length form
a Wu-Manber machine over word numbers:

* a *shift table* keyed by the block of the last two words says how far the
  search may jump, since no window can end sooner (unknown blocks jump almost
  a whole window, so most document words are never looked at);
* blocks with shift 0 lead to a *suffix bucket*, which holds the windows that
  end in this block, split once more by their first two words;
* the windows left are compared word by word with the document.

A document word inside any occurrence is *hit*.

Defined cases: null and empty texts have no words and are not contaminated;
a benchmark item without words is ignored; a null item id counts as ''; equal
windows of several items count for each of them; repeated item rows count
once; an empty benchmark hits nothing.  Whole texts are searched, whatever
their length, at one int per word of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.common import attach, kept, small_batches, unused

#: Bytes of benchmark text that one pass sends to the executors.
MAX_BROADCAST_BYTES = 32 << 20

#: Lower-cases A-Z and turns every ASCII byte that is no word byte into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of non-ASCII characters."""
    return raw.translate(_FOLD).split() if raw else []


class WuManber:
    """All windows of one length, over word numbers (0: a word of no window)."""

    def __init__(self, length: int, windows: dict[tuple[int, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[int, ...], int] = {}
        self.buckets: dict[tuple[int, ...], dict[tuple[int, ...], dict[tuple[int, ...], set[str]]]] = {}
        b = self.block
        for window, items in windows.items():
            for end in range(b, length + 1):
                key = window[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets.setdefault(window[-b:], {}).setdefault(window[:b], {})[window] = items

    def search(self, ids: list[int]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of every occurrence."""
        m, b, shift, default, n = self.length, self.block, self.shift, self.default, len(ids)
        end = m
        while end <= n:
            if not ids[end - 1]:
                end += m
                continue
            key = tuple(ids[end - b : end])
            jump = shift.get(key, default)
            if jump:
                end += jump
                continue
            start = end - m
            close = self.buckets[key].get(tuple(ids[start : start + b]))
            if close and (items := close.get(tuple(ids[start:end]))):
                yield start, items
            end += 1


class Matcher:
    """The machines of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item_id, raw in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(raw))
            m = min(window, len(ids))
            for s in range(len(ids) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(ids[s : s + m], set()).add(item_id)
        self.machines = [WuManber(m, by_length[m]) for m in sorted(by_length)]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans (word positions, end exclusive) and the items found."""
        number = self.number.get
        ids = [number(w, 0) for w in words]
        found: set[str] = set()
        spans: list[tuple[int, int]] = []
        for machine in self.machines:
            for start, items in machine.search(ids):
                spans.append((start, start + machine.length))
                found |= items
        return merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_RESULT = "n_words long, n_hit long, spans array<struct<start: int, end: int>>, item_ids array<string>"


def _matcher(key: str, items: list[tuple[str, bytes]], window: int) -> Matcher:
    return kept("matcher", key, lambda: Matcher(items, window))


def _pack(rows: list[tuple]) -> pa.StructArray:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.StructArray.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([sum(e - s for s, e in r[1]) for r in rows], pa.int64()),
            pa.array([[{"start": s, "end": e} for s, e in r[1]] for r in rows], pa.list_(span)),
            pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
        ],
        names=["n_words", "n_hit", "spans", "item_ids"],
    )


def _scanner(spark, items: list[tuple[str, bytes]], window: int):
    sent = spark.sparkContext.broadcast(items)
    key = hashlib.sha1(repr((window, items)).encode()).hexdigest()

    @F.arrow_udf(_RESULT)
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in small_batches(batches):
            matcher, rows = _matcher(key, sent.value, window), []
            for raw in texts.cast(pa.binary()).to_pylist():
                words = words_of(raw)
                rows.append((len(words), *matcher.scan(words)))
            yield _pack(rows)

    @F.arrow_udf(_RESULT)
    def later(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, before in small_batches(batches):
            matcher, rows = _matcher(key, sent.value, window), []
            for raw, old in zip(texts.cast(pa.binary()).to_pylist(), before.to_pylist(), strict=True):
                words = words_of(raw)
                spans, found = matcher.scan(words)
                spans = merge(spans + [(s["start"], s["end"]) for s in old["spans"]])
                rows.append((len(words), spans, found | set(old["item_ids"])))
            yield _pack(rows)

    return first.asNondeterministic(), later.asNondeterministic()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    words_per_hit: int = 20,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    into: str = "decontamination",
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, spans, item_ids, contaminated.

    A document is contaminated if at least one word in ``words_per_hit`` is
    hit.  The benchmark is measured first.  Up to ``max_broadcast_bytes`` of it are
    sent to the executors at once; a larger one is dealt by item into as many
    blocks as needed and the documents pass one block after the other, each
    adding its spans and items, with no shuffle of the documents.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 64)).first()[0] or 0
    blocks = max(1, -(-size // max_broadcast_bytes))
    marker = unused(docs, f"__{into.lower()}")
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        rows = sorted((r["i"], r["t"].encode()) for r in part.distinct().collect())
        first, later = _scanner(spark, rows, window)
        value = first(F.col(text)) if k == 0 else later(F.col(text), F.col(marker))
        out = attach(out, marker, value)
    r = F.col(marker)
    verdict = (r["n_hit"] > 0) & (words_per_hit * r["n_hit"] >= r["n_words"])
    return attach(out, into, F.struct(r["n_words"].alias("n_words"), r["n_hit"].alias("n_hit"), r["spans"].alias("spans"), r["item_ids"].alias("item_ids"), verdict.alias("contaminated"))).drop(marker)
