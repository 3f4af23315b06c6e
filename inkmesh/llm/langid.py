"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text is built.  A text is
parsed greedily against it: from each place the longest stretch that occurs in
the language's text is one phrase, and the next phrase starts behind it.  Few
phrases mean that the text is made of the language's pieces; the entropy
estimate is ``phrases * log2(size of the language's text) / length``, and the
language with the least estimate wins (ties: the first in code-point order).

A phrase needs forward transitions only, so each automaton becomes a table in
which a missing transition already leads to the state after the next phrase's
first letter, marked by a bit-wise complement.  Many texts are then walked in
step, one gather per letter and language; the few longest of a batch are
walked one by one, so no text is ever cut.

Texts are lower-cased and every run of non-letters counts as one space.

Learning takes, per language, the ``docs_per_language`` texts that are first
by hash in as many hash buckets, and of each a stretch of ``chars_per_doc``
characters from a place drawn by hash; the automata are of these stretches,
``symbols_per_language`` symbols of each language at most.

The ``MAX_ALPHABET`` most frequent letters of the samples have a symbol each.
Any other letter of theirs, whatever its script, is spelled as six symbols, the
digits of its code point, so all letters are told apart in tables of a fixed width.

Defined cases: a null text and one without a letter get ``und`` and score 0;
rows with a null language are not learned from; with nothing to learn from all
texts get ``und``; letters that no sample has are one phrase each; of
repeated rows each is predicted alike; a column named as ``into`` is replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.common import attach, fold, kept, small_batches

DOCS_PER_LANGUAGE = 64
CHARS_PER_DOC = 512
SYMBOLS_PER_LANGUAGE = 33_000
#: Letters with a symbol of their own; the rest are spelled in digits of four bits.
MAX_ALPHABET, DIGITS = 96, 6
#: With fewer texts left in a batch, these are walked one by one.
FEW = 24
#: Letters of text that count as evidence, at most, in the score.
SCORE_LENGTH = 200

_IS_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters being one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    keep = _IS_LETTER[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        keep = keep | (high & np.fromiter((chr(p).isalpha() for p in points), bool, len(points)))
    points = np.where(keep, points, 0)
    return points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))] if len(points) else points


class Automaton:
    """Suffix automaton of one symbol sequence, as a table of ``width`` columns."""

    def __init__(self, symbols: list[int], width: int):
        n = len(symbols)
        step = np.full((2 * n + 2, width), -1, np.int32)
        link, size = [-1], [0]
        last, count = 0, 1
        for c in symbols:
            cur = count
            count += 1
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and step[p, c] == -1:
                step[p, c] = cur
                p = link[p]
            if p != -1:
                q = int(step[p, c])
                if size[q] == size[p] + 1:
                    link[cur] = q
                else:
                    clone = count
                    count += 1
                    size.append(size[p] + 1)
                    link.append(link[q])
                    step[clone] = step[q]
                    while p != -1 and step[p, c] == q:
                        step[p, c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        # one more state follows a letter that the language lacks: whatever comes next starts a phrase
        step = np.vstack([step[:count], np.full((1, width), -1, np.int32)])
        restart = np.where(step[0] == -1, count, step[0])
        self.table = np.where(step == -1, ~restart[None, :], step).astype(np.int32)
        self.table[0] = restart  # only the first letter of a text is read at the root, and its phrase is counted already
        self.cost = math.log2(max(2, n))


class Identifier:
    """Automata of all languages in one table."""

    def __init__(self, samples: dict[str, list[str]], symbols_per_language: int = SYMBOLS_PER_LANGUAGE):
        self.names = sorted(samples)
        points = [np.concatenate([letters(t + " ") for t in samples[k]] or [np.zeros(0, np.uint32)]) for k in self.names]
        seen, counts = np.unique(np.concatenate(points) if points else np.zeros(0, np.uint32), return_counts=True)
        common = sorted(zip(-counts, seen, strict=True))[:MAX_ALPHABET]
        own = sorted(int(p) for _, p in common if p)
        self.digits = len(own) + 1
        self.width = self.digits + 17
        self.symbol = np.full(0x110000, self.width - 1, np.int16)  # letters of no sample
        self.symbol[seen] = -1
        self.symbol[[0, *own]] = np.arange(len(own) + 1)
        automata = [Automaton(self.coded(p)[:symbols_per_language].tolist(), self.width) for p in points]
        self.costs = np.array([a.cost for a in automata])
        self.start = np.cumsum([0, *[len(a.table) for a in automata]])[:-1].astype(np.int64)
        parts = []
        for a, base in zip(automata, self.start, strict=True):
            parts.append(np.where(a.table < 0, ~(~a.table + base), a.table + base))
        self.table = np.concatenate(parts).astype(np.int32).ravel() if parts else np.zeros(0, np.int32)

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Code points to symbols."""
        known = self.symbol[points].astype(np.int32)
        rare = known < 0
        if not rare.any():
            return known
        lengths = np.where(rare, DIGITS, 1)
        at = np.repeat(np.arange(len(points)), lengths)
        digit = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.where(rare[at], self.digits + (points[at].astype(np.int64) >> 4 * (DIGITS - 1 - digit) & 15), known[at]).astype(np.int32)

    def _alone(self, symbols: np.ndarray, at: int, states: list[int], counts: np.ndarray) -> None:
        """Walks the rest of one text."""
        rest, table, width = symbols[at:].tolist(), memoryview(self.table), self.width
        for k, state in enumerate(states):
            phrases = 0
            for c in rest:
                state = table[state * width + c]
                if state < 0:
                    phrases += 1
                    state = ~state
            counts[k] += phrases

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text against each language."""
        texts = [self.coded(t) for t in texts]
        n, k = len(texts), len(self.names)
        counts = np.ones((n, k), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        symbols = np.concatenate([texts[i] for i in order])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        state = np.tile(self.start, (n, 1))
        found = np.zeros((n, k), np.int64)
        live, t = n, 0
        longest = int(sizes[0])
        alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # texts with at least t + 1 letters
        while t < longest and (live := int(alive[t])) >= FEW:
            v = self.table[state[:live] * self.width + symbols[begin[:live] + t][:, None]]
            sign = v >> 31
            found[:live] -= sign
            state[:live] = v ^ sign
            t += 1
        if t < longest:
            for i in range(int(alive[t])):
                self._alone(symbols[begin[i] : begin[i] + sizes[i]], t, state[i].tolist(), found[i])
        counts[order] += found
        return counts

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points = [letters(t) if t else np.zeros(0, np.uint32) for t in texts]
        able = [i for i, p in enumerate(points) if self.names and p.any()]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if able:
            some = [points[i] for i in able]
            sizes = np.fromiter(map(len, some), float, len(some))
            entropy = self.phrases(some) * self.costs / sizes[:, None]
            best = entropy.argmin(axis=1)
            gap = entropy - entropy[np.arange(len(some)), best][:, None]
            share = 1 / np.exp2(-gap * np.minimum(sizes, SCORE_LENGTH)[:, None]).sum(axis=1)
            for i, b, s in zip(able, best, share, strict=True):
                names[i], scores[i] = self.names[b], float(s)
        return names, scores


def learn(
    docs: DataFrame,
    train_where=None,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
    chars_per_doc: int = CHARS_PER_DOC,
) -> dict[str, list[str]]:
    """Text samples by language.

    The number of rows that reach the driver is ``docs_per_language`` times
    the number of distinct languages; ids are chosen by a grouped minimum, so
    that a language with most of the rows costs no more than another.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_column).isNotNull())
    if train_where is not None:
        known = known.where(train_where)
    h = F.xxhash64(id_column)
    chosen = (
        known.select(F.col(lang).alias("__l"), F.col(id_column).alias("__i"), h.alias("__h"))
        .groupBy("__l", F.pmod("__h", F.lit(docs_per_language)).alias("__b"))
        .agg(F.min_by("__i", "__h").alias("__i"))
        .select("__i")
        .distinct()
    )
    place = F.pmod(F.xxhash64(id_column, F.lit("place")), F.greatest(F.lit(1), F.length(text) - chars_per_doc + 1)) + 1
    texts = known.select(F.col(id_column).alias("__i"), F.col(lang).alias("__l"), F.substring(F.col(text), place.cast("int"), F.lit(chars_per_doc)).alias("__t"))
    rows = texts.join(F.broadcast(chosen), "__i").distinct().collect()  # bounded: docs_per_language ids per language
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["__l"], hashlib.sha1(r["__t"].encode()).digest())):
        got = samples.setdefault(r["__l"], [])
        if r["__t"] not in got:
            got.append(r["__t"])
    return samples


def identify_language(docs: DataFrame, samples: dict[str, list[str]], text: str = "text", symbols_per_language: int = SYMBOLS_PER_LANGUAGE, into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    key = hashlib.sha1(repr((symbols_per_language, sorted(samples.items()))).encode()).hexdigest()

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in small_batches(batches):
            made = kept("language", key, lambda: Identifier(sent.value, symbols_per_language))
            names, scores = made.identify(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return attach(docs, into, run.asNondeterministic()(F.col(text)))


def held_out(id_column: str = "doc_id"):
    return fold(id_column, 4) == 2
