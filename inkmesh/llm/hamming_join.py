"""MinHash near-duplicates by a multi-index Hamming join, with exact confirmation.

A text's set is that of its two-word shingles, and its signature is one b-bit
min-hash for each of ``CHUNKS * CHUNK`` hash functions.  The distance of two
signatures is the number of places in which they differ.  Signatures are split
into ``CHUNKS`` chunks.  By the pigeonhole principle two signatures within
``radius = CHUNKS * (ERRORS + 1) - 1`` have a chunk with at most ``ERRORS``
differing places.  The errors a chunk may have are enumerated: for each choice
of ``ERRORS`` of its places, the others make a key, under which both texts meet.
So all pairs within the radius meet; which pairs meet is no matter of chance.
A pair of sets of similarity s lies beyond the radius if over ``radius`` of the
places differ, of which each does with chance 1 - s: with 20 chunks of 5 places,
1 error and s = 0.8 that is 4 in a million, and less for more similar ones.

Texts of a key are treated by their number:

* up to ``SMALL`` of them are paired; pairs whose sizes forbid the threshold drop out;
* texts that share a larger key, directly or over others, are a *group*, which is
  never spelled out as pairs.  It is dealt into blocks of about ``BLOCK`` texts
  of like size, and the signatures of each two blocks whose sizes allow the
  threshold are compared in place.  That gives each text a list of those within
  the radius, nearest first, which is confirmed in two waves: first the nearest
  ``NEAREST`` of each block, then, on the sets themselves and in place, all that the
  links found so far have not joined with it.  What is confirmed grows with the texts of a group and with the near
  misses between classes, not with its pairs.  No partner within the radius is
  left out unless it is joined already.

Links are confirmed on full sets, in whole numbers, and texts are joined to
components.  Texts of one set are collapsed to one before all this.

Words are runs of characters other than space, tab, line feed, vertical tab,
form feed and carriage return; A-Z are lower-cased.  Sets are sets of 64-bit
hashes; sets themselves are named by 64 bits of a 128-bit hash.

Defined cases: a text of one word has one shingle, that word; null and empty
texts, and those of white space only, have none and are linked with nothing;
repeated rows are copies, and each row has its own row in the result; a null id
sorts first; texts of any length are used whole; an empty table gives no rows;
columns of any names may be present.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.common import attach, materialize, shared_dir, small_batches
from inkmesh.llm.lsh_forest import Shingler, set_key, signatures, sized_broadcast
from inkmesh.operators.components import connected

SHINGLE = 2
#: Links have ``PERCENT`` times the union's size in a hundred times the intersection's.
PERCENT = 80
CHUNKS, CHUNK, ERRORS = 20, 5, 1
#: Bytes of a place of a signature.
PLACE_BYTES = 2
SMALL, BLOCK = 24, 1024
#: Shingles of a block's sets on average at most.
BLOCK_SHINGLES = 1 << 20
#: Of a text's list in a pair of blocks, so many are confirmed in the first wave.
NEAREST = 2


class AsciiShingler(Shingler):
    """Shingles over words parted by ASCII white space, with only A-Z lower-cased."""

    space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    place = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    def words_of(self, raw: bytes) -> np.ndarray:
        raw = np.frombuffer(b" %b " % raw.translate(self.place), np.uint8)
        most, parts, at = 1 << 20, [], 0
        while at < len(raw) - 1:
            end = min(at + most, len(raw) - 1)
            while not self.space[raw[end]]:
                end += 1
            parts.append(self._hashed(raw[at : end + 1]))
            at = end
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _hashed(self, raw: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each word; ``raw`` begins and ends with a space.

        The parent finds words by its own, wider class of spaces, so bytes that
        are spaces to it alone are moved out of the way first: to bytes that no UTF-8 text has.
        """
        odd = (raw >= 0x1C) & (raw <= 0x1F)
        if odd.any():
            raw = np.where(odd, raw + 0xDC, raw).astype(np.uint8)  # 0xF8 to 0xFB
        return self._part(raw)

    def set_of(self, raw: bytes | None) -> np.ndarray:
        """Sorted distinct shingles of a UTF-8 text."""
        h = self.words_of(raw or b"")
        return np.unique(self.joined(h)) if len(h) else h

    def joined(self, h: np.ndarray) -> np.ndarray:
        from inkmesh.llm.lsh_forest import _PRIME_MIX, mix

        w = min(self.width, len(h))
        out = np.full(len(h) - w + 1, w * _PRIME_MIX[0] % (1 << 64), np.uint64)
        for i in range(w):
            out += h[i : len(h) - w + 1 + i] * self.factors[i]
        return mix(out)


_SHINGLERS: dict[int, AsciiShingler] = {}


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    make = _SHINGLERS.setdefault(width, AsciiShingler(width))
    return [make.set_of(t.as_py()) for t in texts.cast(pa.binary())]


def described(docs: DataFrame, width: int, places: int, into: str) -> DataFrame:
    """Adds a struct ``into``: set key (null without words), set size and signature."""

    @F.arrow_udf("key binary, size int, signature binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in small_batches(batches):
            keys, sizes, signs = [], [], []
            for lo in range(0, len(texts), 256):
                sets = _sets(texts.slice(lo, 256), width)
                full = [s for s in sets if len(s)]
                each = iter(signatures(full, places)) if full else iter(())
                for s in sets:
                    keys.append(set_key(s))
                    sizes.append(len(s))
                    signs.append(next(each).tobytes() if len(s) else None)
            yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())], names=["key", "size", "signature"])

    return attach(docs, into, run.asNondeterministic()(F.col("text")))


def with_sets(docs: DataFrame, width: int, into: str) -> DataFrame:
    """Adds a struct ``into``: set key and the set, sorted numbers in one string of bytes."""

    @F.arrow_udf("key binary, members binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in small_batches(batches):
            sets = _sets(texts, width)
            yield pa.StructArray.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "members"])

    return attach(docs, into, run.asNondeterministic()(F.col("text")))


def index_keys(signature: Column, chunks: int, chunk: int, errors: int) -> Column:
    """Array of the keys of a signature: for each chunk, and each choice of places that may differ, a hash of the other places."""
    from itertools import combinations

    place = lambda c, i: F.substring(signature, PLACE_BYTES * (c * chunk + i) + 1, PLACE_BYTES)
    keys = []
    for c in range(chunks):
        for m, kept in enumerate(combinations(range(chunk), chunk - errors)):
            runs: list[list[int]] = []
            for i in kept:
                if runs and runs[-1][-1] == i - 1:
                    runs[-1].append(i)
                else:
                    runs.append([i])
            parts = [F.substring(signature, PLACE_BYTES * (c * chunk + r[0]) + 1, PLACE_BYTES * len(r)) for r in runs]
            keys.append(F.xxhash64(F.lit(c * 1000 + m), *parts))
    return F.array(*keys)


def met(wide: DataFrame, chunks: int, chunk: int, errors: int, small: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, ties): pairs a < b of texts that share a key of at most ``small`` texts, and (least, other) of larger ones."""
    flat = wide.select("rep", F.explode(index_keys(F.col("signature"), chunks, chunk, errors)).alias("bucket"))
    counted = flat.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("n > 1")
    counted = materialize(counted, folder, "keys")
    two = counted.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    many = counted.where("n > 2").select("bucket", "n", "low")
    rows = materialize(flat.join(sized_broadcast(many), "bucket").select("bucket", "n", "low", "rep"), folder, "keyed")
    lists = rows.where(F.col("n") <= small).groupBy("bucket").agg(F.array_sort(F.collect_list("rep")).alias("m"))  # at most ``small`` each
    inner = "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b))))"
    pairs = two.unionByName(lists.select(F.explode(F.expr(inner)).alias("p")).select("p.a", "p.b")).where("a < b").distinct()
    ties = rows.where((F.col("n") > small) & (F.col("low") != F.col("rep"))).select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    return pairs, ties


def may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def cells(groups: DataFrame, percent: int, block: int, folder: str) -> DataFrame:
    """Rows (rep, size, first, cell): each text of a group in each two blocks that it is compared in.

    Texts are classed by the logarithm of their size, so that those of classes
    further than one apart cannot be linked, and a class is dealt into blocks by hash.
    """
    kind = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(0.99 * percent / 100)))
    groups = materialize(groups.withColumn("kind", kind), folder, "classed")
    blocks = materialize(groups.groupBy("root", "kind").agg(F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks")), folder, "blocks")
    dealt = groups.join(sized_broadcast(blocks), ["root", "kind"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = materialize(dealt, folder, "dealt")
    found = []
    for d in (0, 1, -1):
        theirs = blocks.select("root", (F.col("kind") - d).alias("kind"), F.col("blocks").alias("theirs"))
        each = dealt.join(sized_broadcast(theirs), ["root", "kind"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
        own, other = F.struct("kind", "block"), F.struct((F.col("kind") + d).alias("kind"), F.col("other").alias("block"))
        found.append(each.select("rep", "size", (own <= other).alias("first"), F.xxhash64("root", F.least(own, other), F.greatest(own, other)).alias("cell")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def near_lists(placed: DataFrame, places: int, radius: int, percent: int, most: int) -> DataFrame:
    """(a, b): for each text of a cell the nearest ``most`` of those within the radius that may be linked, without those of its component.

    ``placed`` has rep, size, root (its component so far), signature, first and cell.
    """

    def nearest(far: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the nearest ``most`` of each row."""
        i, j = [], []
        for row in np.flatnonzero(ok.any(axis=1)).tolist():
            at = np.flatnonzero(ok[row])
            at = at[np.argsort(far[row, at], kind="stable")][:most]
            i.append(np.full(len(at), row))
            j.append(at)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))

    def run(table: pa.Table) -> pa.Table:
        rep, size, root, first = (table[c].to_numpy(zero_copy_only=False) for c in ("rep", "size", "root", "first"))
        sign = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(len(rep), places)
        order = np.argsort(rep)
        rep, size, root, first, sign = rep[order], size[order].astype(np.int64), root[order], first[order], sign[order]
        whole = bool(first.all())
        left = np.flatnonzero(first)
        right = left if whole else np.flatnonzero(~first)
        far, theirs = np.empty((len(left), len(right)), np.uint16), sign[right]
        for n, i in enumerate(left.tolist()):
            far[n] = (theirs != sign[i]).sum(axis=1)
        ok = (far <= radius) & (100 * np.minimum.outer(size[left], size[right]) >= percent * np.maximum.outer(size[left], size[right])) & (root[left][:, None] != root[right])
        i, j = nearest(far, ok)
        if not whole:  # else a row is a column, too
            more_j, more_i = nearest(far.T, ok.T)
            i, j = np.concatenate([i, more_i]), np.concatenate([j, more_j])
        x, y = rep[left[i]], rep[right[j]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return placed.groupBy("cell").applyInArrow(run, "a long, b long")


def linked_in_place(placed: DataFrame, places: int, radius: int, percent: int) -> DataFrame:
    """Links (a, b) of each cell that join texts of different components, confirmed in the cell; of what they join there, a forest.

    ``placed`` is that of ``near_lists`` with ``members``.  Every pair within the
    radius that may be linked is confirmed, unless links have joined it before.
    """

    def run(table: pa.Table) -> pa.Table:
        rep, size, first = (table[c].to_numpy(zero_copy_only=False) for c in ("rep", "size", "first"))
        root = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        sign = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(len(rep), places)
        sets = [np.frombuffer(m.as_py(), np.uint64) for m in table["members"]]
        size = size.astype(np.int64)
        whole = bool(first.all())
        left = np.flatnonzero(first)
        right = left if whole else np.flatnonzero(~first)
        a, b = [], []
        for i in left.tolist():
            theirs = right[(right > i) & (root[right] != root[i])] if whole else right[root[right] != root[i]]
            theirs = theirs[100 * np.minimum(size[i], size[theirs]) >= percent * np.maximum(size[i], size[theirs])]
            far = (sign[theirs] != sign[i]).sum(axis=1)
            near = np.flatnonzero(far <= radius)
            for j in theirs[near[np.argsort(far[near], kind="stable")]].tolist():
                if root[j] == root[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    a.append(min(rep[i], rep[j]))
                    b.append(max(rep[i], rep[j]))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("cell").applyInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets (rep, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch["a_set"], batch["b_set"], strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                rows.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(rows, pa.bool_())).select(["a", "b"])

    side = lambda p: sets.select(F.col("rep").alias(p), F.col("members").alias(f"{p}_set"))
    return side("a").join(sized_broadcast(pairs), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


class _Sets:
    """Sets of texts, each cut from one document and written once, when a wave first needs it."""

    def __init__(self, source: DataFrame, wide: DataFrame, width: int, folder: str):
        self.source, self.wide, self.width, self.folder, self.written = source, wide, width, folder, []

    def of(self, pairs: DataFrame) -> DataFrame:
        new = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        for old in self.written:
            new = new.join(old.select("rep"), "rep", "left_anti")
        k = len(self.written)
        used = materialize(self.wide.join(new, "rep", "left_semi").select("rep", "id"), self.folder, f"used{k}")
        ids = materialize(used.select(F.col("id").alias("used_id")).distinct(), self.folder, f"used_ids{k}")
        chosen = self.source.join(sized_broadcast(ids), F.col("id").eqNullSafe(F.col("used_id")), "left_semi")
        sets = with_sets(chosen, self.width, "s").select(F.xxhash64("s.key").alias("rep"), F.col("s.members").alias("members"))
        # a document of another text may share the id, and rows may be repeated
        sets = sets.join(sized_broadcast(used.select("rep")), "rep", "left_semi")
        sets = materialize(sets, self.folder, f"sets{k}")
        if sets.count() != used.count():
            sets = materialize(sets.dropDuplicates(["rep"]), self.folder, f"sets_once{k}")
        self.written.append(sets)
        out = self.written[0]
        for more in self.written[1:]:
            out = out.unionByName(more)
        return out


def hamming_join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    width: int = SHINGLE,
    chunks: int = CHUNKS,
    chunk: int = CHUNK,
    errors: int = ERRORS,
    small: int = SMALL,
    block: int = BLOCK,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: one row per document: ``id``, ``n_shingles``, ``component_id``
    (smallest id reachable), ``kept`` (whether the id is that of its component).
    links: the confirmed links between different sets (``a``, ``b``) that join
    them, named by set; those within a component that earlier links joined are
    not among them.
    """
    folder = folder or shared_dir(docs.sparkSession)
    places, radius = chunks * chunk, chunks * (errors + 1) - 1
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    base = materialize(described(source, width, places, "d").select("id", "d.*"), folder, "described")
    worded = base.where("key is not null").withColumn("rep", F.xxhash64("key"))
    reps = materialize(worded.groupBy("rep").agg(F.min("id").alias("id"), F.count("*").alias("copies")), folder, "reps")
    copied = materialize(reps.where("copies > 1").select(F.col("rep").alias("r"), F.col("id").alias("i")), folder, "copied")
    marked = worded.join(sized_broadcast(copied), F.col("rep") == F.col("r"), "left").withColumn("copied", F.col("r").isNotNull())
    stands = ["rep", "id", "size", "signature"]
    lone, first_of_many = marked.where("not copied").select(*stands), marked.where(F.col("copied") & F.col("id").eqNullSafe(F.col("i"))).select(*stands)
    wide = materialize(lone.unionByName(first_of_many.dropDuplicates(["rep"])), folder, "wide")  # one row for a set
    pairs, ties = met(wide, chunks, chunk, errors, small, folder)
    groups = connected(ties, f"{folder}/groups").withColumnsRenamed({"node": "rep", "component": "root"})
    groups = materialize(groups, folder, "grouped")
    of = lambda p: sized_broadcast(wide.select(F.col("rep").alias(p), F.col("size").alias(f"{p}_size")))
    sets = _Sets(source, wide, width, folder)
    likely = pairs.join(of("a"), "a").join(of("b"), "b").where(may_link(F.col("a_size"), F.col("b_size"), percent)).select("a", "b")
    likely = _within(likely, wide, radius, places)
    grouped = bool(groups.limit(1).count())
    if grouped:
        own = materialize(groups.withColumnRenamed("root", "group").join(wide.select("rep", "size", "signature"), "rep"), folder, "group_signatures")
        placed = materialize(cells(own.select("rep", "size", F.col("group").alias("root")), percent, block, folder), folder, "cells")
        signs = own.select("rep", "signature", F.col("rep").alias("root"))
        likely = likely.unionByName(near_lists(placed.join(signs, "rep"), places, radius, percent, NEAREST)).distinct()
    likely = materialize(likely, folder, "likely")
    links = materialize(confirmed(likely, sets.of(likely), percent), folder, "links")
    roots = connected(links, f"{folder}/roots").withColumnsRenamed({"node": "rep", "component": "root"})
    if grouped:
        roots = materialize(roots, folder, "roots_so_far")
        now = own.select("rep", "signature").join(sized_broadcast(roots), "rep", "left").select("rep", "signature", F.coalesce("root", "rep").alias("root"))
        full = sets.of(groups.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
        signed = materialize(now.join(full, "rep"), folder, "signed")
        more = materialize(linked_in_place(placed.join(signed, "rep"), places, radius, percent), folder, "more_links")
        joined = roots.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(more)
        links = links.unionByName(more)
        roots = connected(joined, f"{folder}/all_roots").withColumnsRenamed({"node": "rep", "component": "root"})
    named = roots.join(reps.select("rep", "id"), "rep")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    joined = named.join(least, "root").select("rep", "component_id")
    alone = reps.where("copies > 1").join(roots, "rep", "left_anti").select("rep", F.col("id").alias("component_id"))
    known = materialize(joined.unionByName(alone).withColumn("joined", F.lit(True)), folder, "joined")
    members = base.select("id", "size", F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("rep")).join(sized_broadcast(known), "rep", "left")
    members = members.select("id", F.coalesce("size", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return members.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), links


def _within(pairs: DataFrame, wide: DataFrame, radius: int, places: int) -> DataFrame:
    """The pairs (a, b) whose signatures are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(len(batch), places) for c in ("a_sign", "b_sign"))
            yield batch.filter(pa.array((x != y).sum(axis=1) <= radius)).select(["a", "b"])

    side = lambda p: wide.select(F.col("rep").alias(p), F.col("signature").alias(f"{p}_sign"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sign", "b_sign").mapInArrow(run, "a long, b long")
