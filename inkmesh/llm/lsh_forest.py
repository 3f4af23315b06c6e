"""N-gram Jaccard join by MinHash prefixes of fixed length with exact verification.

A text's set is that of its five-word shingles.  There are ``trees`` signatures
of ``depth`` values, as in an LSH forest, but buckets of one prefix length take
the place of its sorted tries: no text falls back to a shorter prefix when it
has few matches.  The length is the longest ``k`` at which a pair at the
threshold meets in some tree with the target recall, ``1 - (1 - s^k)^trees``.  Buckets (tree, prefix of
``k`` values) are then treated by their size:

* the texts of a bucket of at most ``small`` are joined completely;
* texts that share a larger bucket, directly or over others, are a *group*.  A
  group is not spelled out as pairs: its texts are dealt into blocks of about
  equal set size, and each two blocks whose sizes allow the threshold are
  compared as a whole, by a product of their text-shingle matrices.  All pairs
  of a group are so verified exactly, whether they meet in a bucket or not; two
  blocks give a count of links and a link to a local root for each text, not
  the links themselves.

Candidates are verified exactly on the shingle sets.  Links join texts to
classes (connected components).  A pair at the threshold is found with the
target recall, whatever the size of its group.  A group of n texts costs about
n^2 / 2 comparisons of sets and sends each set to n / ``BLOCK`` tasks.  Texts
with equal sets are collapsed to their smallest id before the forest, however
many there are, and count as linked to one another.

Words are the runs of non-space characters of the lower-cased text.  Defined
cases: a text of one to four words has one shingle, all of it; a text without
words (null, empty) has no shingles, is its own class and has no links;
repeated rows are copies of one another; a null id is a value like any other
(it sorts first); an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.common import attach, materialize, shared_dir, small_batches, unused

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 8
TARGET_RECALL = 0.995
SMALL_BUCKET = 24
#: Texts, and shingles of them, that a block of a large group has on average at most.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Columns of the text-shingle matrix that are multiplied at once.
BLOCK_COLUMNS = 4096
#: A pair is verified unless its signatures agree so much less often than the
#: threshold that chance does not explain it (in standard deviations).
SCREEN_DEVIATIONS = 6.0
#: Bytes of a signature value; a chance match of two values only makes a candidate more.
VALUE_BYTES = 2
#: Rows of a few numbers each up to which a written table is sent to all tasks.
MAX_BROADCAST_ROWS = 400_000
_PRIME_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def prefix_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix with which ``trees`` trees reach the target at the threshold."""
    return next((k for k in range(depth, 1, -1) if 1 - (1 - threshold**k) ** trees >= target), 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_PRIME_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_PRIME_MIX[2])
    return x ^ (x >> np.uint64(31))


#: Bytes of a text that are hashed at once, up to the next space.
HASHED_BYTES = 1 << 20
_SPACE_BYTES = np.fromiter((b < 128 and chr(b).isspace() for b in range(256)), bool, 256)


class Shingler:
    """Texts to 64-bit hashes of their shingles, by whole-array arithmetic.

    A word's hash is a polynomial over its UTF-8 bytes modulo 2^64, taken from
    running sums over the text and scrambled together with its length; a
    shingle's is a sum of its words' hashes with a factor for each place,
    scrambled again.
    """

    def __init__(self, width: int = SHINGLE):
        self.width = width
        rng = np.random.Generator(np.random.PCG64(0x5EED))
        self.factors = rng.integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(1 << 60, 1 << 63)) | 1
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        chain = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
        self.powers, self.inverse = chain(self.base), chain(pow(self.base, -1, 1 << 64))

    def _part(self, raw: np.ndarray) -> np.ndarray:
        """``raw`` begins and ends with a space."""
        space = _SPACE_BYTES.take(raw)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        if len(raw) >= len(self.powers):
            self._grow(2 * len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value.take(raw) * self.powers[: len(raw)], out=sums[1:])
        lengths = (ends - starts).astype(np.uint64)
        out = mix((sums[ends] - sums[starts]) * self.inverse[starts] + lengths * np.uint64(_PRIME_MIX[0]))
        if len(self.powers) > 4 * HASHED_BYTES:  # after a word of megabytes
            self._grow(HASHED_BYTES)
        return out

    def words(self, text: str) -> np.ndarray:
        """A hash for each run of non-space characters of the lower-cased text."""
        text = text.lower()
        if not text.isascii():
            text = " ".join(text.split())
        raw = np.frombuffer(b" %b " % text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) <= HASHED_BYTES:
            return self._part(raw)
        parts, at = [], 0
        while at < len(raw) - 1:
            end = min(at + HASHED_BYTES, len(raw) - 1)
            while not _SPACE_BYTES[raw[end]]:
                end += 1
            parts.append(self._part(raw[at : end + 1]))
            at = end
        return np.concatenate(parts)

    def all(self, text: str | None) -> np.ndarray:
        """The hash of each shingle in turn."""
        h = self.words(text or "")
        if not len(h):
            return h
        w = min(self.width, len(h))
        out = np.full(len(h) - w + 1, w * _PRIME_MIX[0] % (1 << 64), np.uint64)
        for i in range(w):
            out += h[i : len(h) - w + 1 + i] * self.factors[i]
        return mix(out)

    def set(self, text: str | None) -> np.ndarray:
        return np.unique(self.all(text))


@functools.lru_cache
def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(0xF0E57))
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n min-hashes of each set (none empty), scrambled and cut to 16 bits."""
    factor, shift = seeds(n)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), n), np.uint32)
    for i in range(n):
        out[:, i] = np.minimum.reduceat(values * factor[i] + shift[i], starts)
    return mix(out.astype(np.uint64)).astype(np.uint16)


_SHINGLERS: dict[int, Shingler] = {}


def shingler(width: int) -> Shingler:
    """One in each Python worker."""
    return _SHINGLERS.setdefault(width, Shingler(width))


def set_key(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def described(docs: DataFrame, text: str, n_hashes: int, width: int, into: str) -> DataFrame:
    """Adds a struct ``into``: set key (128 bits, null without words), set size, signature, and its low bytes."""

    @F.arrow_udf("key binary, size int, signature binary, low binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make = shingler(width)
        for texts in small_batches(batches):
            keys, sizes, signs, lows = [], [], [], []
            for lo in range(0, len(texts), 256):  # bounds the shingles held at once
                sets = [make.set(t.as_py()) for t in texts[lo : lo + 256]]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, n_hashes)) if full else iter(())
                for s in sets:
                    row = next(sig) if len(s) else None
                    keys.append(set_key(s))
                    sizes.append(len(s))
                    signs.append(None if row is None else row.tobytes())
                    lows.append(None if row is None else row.astype(np.uint8).tobytes())
            yield pa.StructArray.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary()), pa.array(lows, pa.binary())], names=["key", "size", "signature", "low"]
            )

    return attach(docs, into, run.asNondeterministic()(F.col(text)))


def with_sets(docs: DataFrame, text: str, width: int, into: str) -> DataFrame:
    """Adds a struct ``into``: set key and the shingle set itself, as a sorted array of longs."""

    @F.arrow_udf("key binary, shingles array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make = shingler(width)
        for texts in small_batches(batches):
            sets = [make.set(t.as_py()) for t in texts]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["key", "shingles"])

    return attach(docs, into, run.asNondeterministic()(F.col(text)))


def sized_broadcast(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table of a few short columns) with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _buckets(tree: Column, signature: Column, depth: int, length: int) -> Column:
    """Hash of a tree's number and of ``length`` signature values from its own on (the last tree goes on with the first)."""
    return F.xxhash64(tree, F.lit(length), F.substring(F.concat(signature, signature), VALUE_BYTES * depth * tree + 1, F.lit(VALUE_BYTES * length)))


def candidates(reps: DataFrame, trees: int, depth: int, length: int, small: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, ties) from the forest; ``reps`` has rep and signature.

    pairs (a < b): those of buckets of at most ``small``.  ties (a, b): the
    least text of a larger bucket and each other one.  A bucket of two is its
    least and greatest id, so only buckets of three or more are joined back to
    their texts.
    """
    rows = reps.select("rep", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    flat = rows.select("rep", _buckets(F.col("tree"), F.col("signature"), depth, length).alias("bucket"))
    counted = flat.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("n > 1")
    counted = materialize(counted, folder, "buckets")
    two = counted.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    many = counted.where("n > 2").select("bucket", "n", "low")
    met = materialize(flat.join(sized_broadcast(many), "bucket").select("bucket", "n", "low", "rep"), folder, "bucketed")
    groups = met.where(F.col("n") <= small).groupBy("bucket").agg(F.array_sort(F.collect_list("rep")).alias("m"))  # at most ``small`` each
    inner = "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b))))"
    pairs = two.unionByName(groups.select(F.explode(F.expr(inner)).alias("p")).select("p.a", "p.b")).where("a < b").distinct()
    ties = met.where(F.col("n") > small).select(F.col("low").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    return pairs, ties


def block_links(sets: list[np.ndarray], first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of all pairs of ``sets`` that reach the threshold.

    Where ``first`` differs, pairs have one set of each kind; otherwise i < j.
    """
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    shared = met[column] > 1  # what one text alone has is in no intersection
    row, column = row[shared], (np.cumsum(met > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    one = bool(first.all() or not first.any())
    left = np.arange(len(sets)) if one else np.flatnonzero(first)
    right = left if one else np.flatnonzero(~first)
    common = np.zeros((len(left), len(right)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        s, e = np.searchsorted(column, [low, low + BLOCK_COLUMNS])
        dense = np.zeros((len(sets), BLOCK_COLUMNS), np.float32)
        dense[row[s:e], column[s:e] - low] = 1
        common += dense[left] @ dense[right].T
    similar = common / (lengths[left][:, None] + lengths[right] - common)
    i, j = np.nonzero(np.triu(similar >= threshold, 1) if one else similar >= threshold)
    return left[i], right[j], similar[i, j]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places, one place of its component of the links (i, j)."""
    linked = np.zeros((n, n), bool)
    linked[i, j] = linked[j, i] = True
    root = np.arange(n)
    seen = ~linked.any(axis=1)
    for start in range(n):
        front = np.array([start] if not seen[start] else [], np.int64)
        while len(front):
            seen[front] = True
            root[front] = start
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
    return root


def cells(groups: DataFrame, threshold: float, folder: str) -> DataFrame:
    """Rows (rep, copies, first, cell): each text in each pair of blocks that it is compared in.

    ``groups`` has rep, root, size and copies.  Texts are classed by the
    logarithm of their size, so that texts of classes further than one apart
    cannot reach the threshold; a class is dealt into blocks by hash.
    """
    kind = F.floor(F.log(F.col("size").cast("double")) / float(-np.log(0.99 * threshold)))  # a little wide, so rounding parts no pair
    groups = materialize(groups.withColumn("kind", kind), folder, "classed")
    share = F.greatest(F.count("*") / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_SHINGLES))
    blocks = materialize(groups.groupBy("root", "kind").agg(F.ceil(share).cast("int").alias("blocks")), folder, "blocks")
    dealt = groups.join(sized_broadcast(blocks), ["root", "kind"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = materialize(dealt, folder, "dealt")
    next_to = lambda d: dealt.join(sized_broadcast(blocks.select("root", (F.col("kind") - d).alias("kind"), F.col("blocks").alias("theirs"))), ["root", "kind"])
    found = []
    for d in (0, 1, -1):
        other = F.struct((F.col("kind") + d).alias("kind"), F.col("other").alias("block"))
        own = F.struct("kind", "block")
        each = next_to(d).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
        found.append(each.select("rep", "copies", (own <= other).alias("first"), F.xxhash64("root", F.least(own, other), F.greatest(own, other)).alias("cell")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def compared(placed: DataFrame, threshold: float, spelled: bool) -> DataFrame:
    """All links within cells; ``placed`` has rep, copies, first, cell and shingles.

    ``spelled``: the links (a < b, similarity).  Otherwise a row for each linked
    text of a cell: rep, its links in documents, and a text it is joined with.
    """

    def run(table: pa.Table) -> pa.Table:
        rep, copies, first = (table[c].to_numpy() for c in ("rep", "copies", "first"))
        i, j, similar = block_links([x.values.to_numpy() for x in table["shingles"]], first, threshold)
        if spelled:
            return pa.table({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j]), "similarity": similar})
        linked = np.zeros(len(rep), np.int64)
        np.add.at(linked, i, copies[j])
        np.add.at(linked, j, copies[i])
        some = np.flatnonzero(linked)
        return pa.table({"rep": rep[some], "linked": linked[some], "root": rep[local_roots(len(rep), i, j)[some]]})

    return placed.groupBy("cell").applyInArrow(run, "a long, b long, similarity double" if spelled else "rep long, linked long, root long")


def agreement(a: Column, b: Column, n: int) -> Column:
    """Share of equal bytes in two byte strings of length n."""
    x, y = F.hex(a), F.hex(b)
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0), lambda s, i: s + (F.substring(x, 2 * i + 1, F.lit(2)) == F.substring(y, 2 * i + 1, F.lit(2))).cast("int")) / F.lit(float(n))


def screened(pairs: DataFrame, groups: DataFrame, reps: DataFrame, threshold: float, n: int, folder: str) -> DataFrame:
    """The pairs that sizes and the signatures' low bytes do not rule out, without those of one group."""
    least = threshold - SCREEN_DEVIATIONS * (threshold * (1 - threshold) / n) ** 0.5
    of = lambda p: sized_broadcast(groups.select(F.col("rep").alias(p), F.col("root").alias(f"{p}_root")))
    apart = F.col("a_root").isNull() | F.col("b_root").isNull() | (F.col("a_root") != F.col("b_root"))
    pairs = materialize(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b"), folder, "pairs")
    met = materialize(pairs.select(F.col("a").alias("rep")).distinct().union(pairs.select("b").distinct()).distinct(), folder, "met")
    known = reps.join(sized_broadcast(met), "rep", "left_semi")
    side = lambda p: known.select(*[F.col(c).alias(f"{p}_{c}" if c != "rep" else p) for c in ("rep", "low", "size")])
    likely = (
        side("a")
        .join(sized_broadcast(pairs), "a")
        .join(side("b"), "b")
        .where(F.least("a_size", "b_size") >= threshold * F.greatest("a_size", "b_size"))
        .where(agreement(F.col("a_low"), F.col("b_low"), n) >= least)
        .select("a", "b")
        .distinct()
    )
    return materialize(likely, folder, "likely")


def sets_of(wanted: DataFrame, reps: DataFrame, source: DataFrame, width: int, folder: str) -> DataFrame:
    """(rep, shingles) of the texts in ``wanted``; only their documents are cut into shingles again."""
    used = reps.join(sized_broadcast(materialize(wanted, folder, "wanted")), "rep", "left_semi").select("rep", "id").distinct()
    used = materialize(used, folder, "used")
    ids = materialize(used.select(F.col("id").alias("used_id")).distinct(), folder, "used_ids")
    chosen = source.join(sized_broadcast(ids), F.col("id").eqNullSafe(F.col("used_id")), "left_semi")
    sets = with_sets(chosen, "text", width, "s").select(F.xxhash64("s.key").alias("rep"), F.col("s.shingles").alias("shingles"))
    sets = materialize(sets.join(sized_broadcast(used.select("rep").distinct()), "rep", "left_semi"), folder, "sets")
    if sets.count() != used.count():  # repeated rows
        sets = materialize(sets.dropDuplicates(["rep"]), folder, "sets_once")
    return sets


def verified(likely: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets reach the threshold, with their exact similarity."""
    set_of = lambda p: sets.select(F.col("rep").alias(p), F.col("shingles").alias(f"{p}_set"))
    both = set_of("a").join(sized_broadcast(likely), "a").join(set_of("b"), "b").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    return both.select("a", "b", (F.col("common") / (F.size("a_set") + F.size("b_set") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= threshold)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(rep, root): the smallest name of each connected component of edges (a, b).

    Alternating large-star and small-star steps, each written to the shared
    folder; the driver sees a count and a sum per step, never the links.
    """
    state = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), folder, "stars0")
    seen = None
    for step in range(1, 200):
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        state = materialize(small, folder, f"stars{step}")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("rep"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("rep"), F.col("v").alias("root"))).distinct()


def one_per_class(docs: DataFrame, members: DataFrame, id_column: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps one document.

    A class keeps its smallest id; of several texts of that id in the class
    the one of smallest hash, and of repeated rows any one.  Texts without
    words all stay.  Rows that go are named by (id, text hash); the documents
    are shuffled only if that list is too long to send to all tasks.
    """
    folder = folder or shared_dir(docs.sparkSession)
    worded = members.where(F.col("key").isNotNull())
    stays = worded.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min("text_hash").alias("kept_hash"))
    rows = worded.groupBy("class_key", "class_id", "id", "text_hash").agg(F.count("*").alias("n"))
    own_id, own_hash = (unused(docs, name) for name in ("stays_id", "stays_hash"))
    judged = rows.join(stays, "class_key").select(
        F.col("id").alias(own_id), F.col("text_hash").alias(own_hash), "n", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("kept_hash"))).alias("stays")
    )
    judged = materialize(judged.where("not stays or n > 1"), folder, "judged")
    goes, repeated = (materialize(judged.where(c).select(own_id, own_hash), folder, name) for c, name in (("not stays", "goes"), ("stays", "repeated")))
    same = F.col(id_column).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash))
    left = docs.join(sized_broadcast(goes), same, "left_anti")
    if not repeated.count():
        return left
    many = sized_broadcast(repeated)
    once = left.join(many, same).dropDuplicates([own_id, own_hash]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return left.join(many, same, "left_anti").unionByName(once)


def jaccard_join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    width: int = SHINGLE,
    trees: int = TREES,
    depth: int = DEPTH,
    target_recall: float = TARGET_RECALL,
    small: int = SMALL_BUCKET,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: one row per document: ``id``, ``key`` (names its shingle set;
    null without words), ``text_hash`` (of the text as it stands),
    ``class_key`` (names the class, even if all its ids are null),
    ``class_id`` (smallest id of its class), ``copy_of`` (smallest id with an equal set) and ``n_links`` (copies and
    verified links, counted in documents).  links: all verified pairs of sets by
    the smallest ids of their copies: ``a_id``, ``b_id``, ``similarity``.
    """
    folder = folder or shared_dir(docs.sparkSession)
    n = trees * depth
    source = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    base = described(source, "text", n, width, "d").select("id", F.xxhash64("text").alias("text_hash"), "d.*")
    base = materialize(base, folder, "described")
    # a set is named by 64 bits of its key from here on
    worded = base.where("key is not null").withColumn("rep", F.xxhash64("key"))
    reps = materialize(worded.groupBy("rep").agg(F.min("id").alias("id"), F.count("*").alias("copies")), folder, "reps")
    # one row stands for a set; only sets with copies need a look-up, so the signatures are not shuffled
    copied = materialize(reps.where("copies > 1").select(F.col("rep").alias("r"), F.col("id").alias("i")), folder, "copied")
    first_only = worded.join(sized_broadcast(copied), F.col("rep") == F.col("r"), "left").where(F.col("r").isNull() | F.col("id").eqNullSafe(F.col("i")))
    wide = first_only.select("rep", "id", "size", "signature", "low")
    pairs, ties = candidates(wide, trees, depth, prefix_length(threshold, trees, depth, target_recall), small, folder)
    groups = materialize(components(ties, f"{folder}/groups"), folder, "grouped")
    likely = screened(pairs, groups, wide, threshold, n, folder)
    ends = likely.select(F.col("a").alias("rep")).distinct().union(likely.select("b").distinct())
    sets = sets_of(ends.union(groups.select("rep")).distinct(), wide, source, width, folder)
    links = materialize(verified(likely, sets, threshold), folder, "links")
    sized = wide.join(sized_broadcast(groups), "rep").groupBy("rep", "root").agg(F.max("size").alias("size")).join(reps.select("rep", "copies"), "rep")
    placed_sets = cells(sized, threshold, folder).join(sets, "rep")
    counts = materialize(compared(placed_sets, threshold, spelled=False), folder, "counts")
    roots = components(links.select("a", "b").unionByName(counts.select(F.col("rep").alias("a"), F.col("root").alias("b"))), folder)
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    degree = ends.join(reps.select(F.col("rep").alias("other"), "copies"), "other").select("rep", F.col("copies").alias("linked"))
    degree = degree.unionByName(counts.select("rep", "linked")).groupBy("rep").agg(F.sum("linked").alias("linked"))
    placed = roots.join(reps, "rep")
    smallest = placed.groupBy("root").agg(F.min("id").alias("class_id"))
    linked = placed.join(smallest, "root").join(degree, "rep").select("rep", "id", "copies", "class_id", "root", "linked")
    alone = reps.where("copies > 1").join(roots, "rep", "left_anti").select("rep", "id", "copies", F.col("id").alias("class_id"), F.col("rep").alias("root"), F.lit(0).cast("long").alias("linked"))
    notable = materialize(linked.unionByName(alone).withColumnRenamed("id", "copy_of"), folder, "notable")
    members = (
        base.select("id", "key", "text_hash", F.xxhash64("key").alias("rep"))
        .join(sized_broadcast(notable), "rep", "left")
        .select(
            "id", "key", "text_hash", F.coalesce("root", "rep").alias("class_key"), F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
            F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
            F.coalesce(F.col("copies") - 1 + F.col("linked"), F.lit(0)).cast("long").alias("n_links"),
        )
    )
    named = reps.select("rep", "id")
    links = links.unionByName(compared(placed_sets, threshold, spelled=True))  # spelled out only if they are read
    links = links.join(named.select(F.col("rep").alias("a"), F.col("id").alias("a_id")), "a").join(named.select(F.col("rep").alias("b"), F.col("id").alias("b_id")), "b").select("a_id", "b_id", "similarity")
    return members, links
