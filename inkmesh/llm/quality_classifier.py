"""Quality classifier: a weak-label model, then a hashed linear scorer.

Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on each
text.  A labeller's votes given the true class follow a table of its own
(Dawid and Skene); expectation-maximisation estimates the tables and the class
share from the votes alone.  It needs only how often each vote pattern occurs,
so the votes of *all* texts are counted per pattern in Spark and the driver
sees at most 3^labellers counts, whatever the corpus.

The posterior of a text's pattern is its soft label.  A logistic scorer over
hashed features (words, word shapes, repeats of the word before) is fitted to
the posteriors of at most ``max_training_rows`` texts, taken by hash of the
text, and scores every whole text.

Defined cases: null and empty texts are one pattern like others and have one
feature of their own; equal texts get equal scores; with no texts nothing is
fitted and the result is empty; if all texts have one pattern the posterior is
that of the start (the share of good votes).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.common import attach, bound_batches, kept, small_batches

MAX_TRAINING_ROWS = 6000
BITS = 16
EPOCHS, BATCH, RATE, L2 = 6, 64, 0.5, 1e-5
KEEP_SCORE = 0.4
MAX_REMEMBERED = 400_000
_SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>{}\\^~="

#: Frequent function words of a few languages.
FUNCTION_WORDS = frozenset(
    """the of and to a in is it that for on with as was be by this are from or an at not have which
    der die das und in zu den mit von ist des sich auf für nicht ein eine im dem auch es an
    le la les de des et en un une du que qui dans pour par est sur au pas plus avec ce
    el los las del y en que por con para una se no es su al lo como más""".split()
)


def vote(value: float, bad_below: float | None = None, good_from: float | None = None, bad_above: float | None = None, good_to: float | None = None) -> int:
    """-1 outside the bad limits, 1 inside the good ones, else 0."""
    if (bad_below is not None and value < bad_below) or (bad_above is not None and value > bad_above):
        return -1
    return int((good_from is None or value >= good_from) and (good_to is None or value <= good_to))


def label_length(t: str, words: list[str], lines: list[str]) -> int:
    return vote(len(words), bad_below=3, good_from=40)


def label_word_length(t: str, words: list[str], lines: list[str]) -> int:
    return vote(sum(map(len, words)) / max(1, len(words)), bad_below=2.5, good_from=3.2, bad_above=12, good_to=8.5)


def label_symbols(t: str, words: list[str], lines: list[str]) -> int:
    return vote(sum(map(t.count, SYMBOLS)) / max(1, len(words)), bad_above=0.2, good_to=0.02)


def label_capitals(t: str, words: list[str], lines: list[str]) -> int:
    return vote(sum(map(str.isupper, words)) / max(1, len(words)), bad_above=0.3, good_to=0.08)


def label_exclamations(t: str, words: list[str], lines: list[str]) -> int:
    return vote(t.count("!") / max(1, len(words)), bad_above=0.2, good_to=0.05)


def label_repetition(t: str, words: list[str], lines: list[str]) -> int:
    windows = list(zip(words, words[1:], words[2:], strict=False))
    return vote(1 - len(set(windows)) / max(1, len(windows)), bad_above=0.3, good_to=0.1) if windows else 0


def label_function_words(t: str, words: list[str], lines: list[str]) -> int:
    return vote(sum(w.lower() in FUNCTION_WORDS for w in words) / max(1, len(words)), bad_below=0.05, good_from=0.12)


def label_variety(t: str, words: list[str], lines: list[str]) -> int:
    return vote(len(set(words)) / max(1, len(words)) ** 0.8, bad_below=0.5, good_from=1.0)


def label_sentences(t: str, words: list[str], lines: list[str]) -> int:
    return vote(sum(w[-1] in ".!?…" for w in words) / max(1, len(words)), bad_below=0.01, good_from=0.03, bad_above=0.6, good_to=0.3)


def label_duplicate_lines(t: str, words: list[str], lines: list[str]) -> int:
    return vote(1 - len(set(lines)) / max(1, len(lines)), bad_above=0.3, good_to=0.15)


LABELLERS = (label_length, label_word_length, label_symbols, label_capitals, label_exclamations, label_repetition, label_function_words, label_variety, label_sentences, label_duplicate_lines)


def votes(text: str | None) -> list[int]:
    t = text or ""
    words = t.split()
    lines = [x for x in t.split("\n") if x.strip(_SPACE)]
    return [f(t, words, lines) for f in LABELLERS]


def pattern(v: list[int]) -> int:
    """The votes as one number in base 3."""
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def unpack(code: int, n: int = len(LABELLERS)) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(n)]


class LabelModel:
    """Class share and, per labeller, the chance of each vote given the class."""

    def __init__(self, counts: dict[int, int], n: int = len(LABELLERS), rounds: int = 200, prior: float = 1.0):
        codes = sorted(counts)
        v = np.array([[x + 1 for x in unpack(c, n)] for c in codes]).reshape(-1, n)
        weight = np.array([counts[c] for c in codes], float)
        said = (v == 2).sum(axis=1) + (v == 0).sum(axis=1)
        good = ((v == 2).sum(axis=1) + 1.0) / (said + 2.0)  # start: share of good votes
        onehot = np.stack([v == k for k in range(3)], axis=2).astype(float)  # pattern, labeller, vote
        last = -np.inf
        for _ in range(rounds):
            self.share = float((weight @ good + prior) / (weight.sum() + 2 * prior))
            table = []
            for p in (1 - good, good):
                counted = np.einsum("p,plk->lk", weight * p, onehot) + prior
                table.append(counted / counted.sum(axis=1, keepdims=True))
            self.table = np.stack(table)  # class, labeller, vote
            log = np.einsum("plk,clk->pc", onehot, np.log(self.table)) + np.log([1 - self.share, self.share])
            top = log.max(axis=1, keepdims=True) if len(log) else log
            total = np.log(np.exp(log - top).sum(axis=1)) + top[:, 0] if len(log) else np.zeros(0)
            good = np.exp(log[:, 1] - total) if len(log) else good
            likelihood = float(weight @ total)
            if likelihood - last < 1e-6 * max(1.0, weight.sum()):
                break
            last = likelihood
        self.posterior = dict(zip(codes, good.tolist(), strict=True))

    def accuracy(self) -> np.ndarray:
        """Of each labeller: the chance that a vote it casts is right."""
        right = (1 - self.share) * self.table[0, :, 0] + self.share * self.table[1, :, 2]
        cast = right + (1 - self.share) * self.table[0, :, 2] + self.share * self.table[1, :, 0]
        return right / cast


def shape(word: str) -> str:
    """A word's look: runs of capitals, small letters, digits and signs."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)[:8]


class Hasher:
    """Words to the hashed features of a text, each a share of its words."""

    def __init__(self, bits: int = BITS):
        self.mask = (1 << bits) - 1
        self.word: dict[str, int] = {}
        self.shape: dict[str, int] = {}
        self.again, self.none = zlib.crc32(b"again") & self.mask, zlib.crc32(b"none") & self.mask

    def _learn(self, words: list[str]) -> None:
        if len(self.word) > MAX_REMEMBERED:
            self.word.clear()
            self.shape.clear()
        for w in set(words):
            if w not in self.word:
                self.word[w] = zlib.crc32(b"w" + w.lower().encode()) & self.mask
                self.shape[w] = zlib.crc32(b"s" + shape(w).encode()) & self.mask

    def features(self, text: str | None) -> np.ndarray:
        """Feature numbers, one for each word, shape and repeat."""
        words = (text or "").split()
        if not words:
            return np.array([self.none])
        n = len(words)
        try:
            a = np.fromiter(map(self.word.__getitem__, words), np.int64, n)
        except KeyError:
            self._learn(words)
            a = np.fromiter(map(self.word.__getitem__, words), np.int64, n)
        b = np.fromiter(map(self.shape.__getitem__, words), np.int64, n)
        repeats = np.full(int((a[1:] == a[:-1]).sum()), self.again)
        return np.concatenate([a, b, repeats])


class Scorer:
    """Logistic regression on hashed features, fitted by Adagrad to soft labels."""

    def __init__(self, rows: list[tuple[np.ndarray, float]], bits: int = BITS):
        self.weight, self.bias = np.zeros(1 << bits), 0.0
        square, square_b = np.full(1 << bits, 1e-4), 1e-4
        order = np.random.Generator(np.random.PCG64(11)).permutation
        scaled = []
        for f, y in rows:
            at, n = np.unique(f, return_counts=True)
            scaled.append((at, n / len(f) * 10, y))
        for _ in range(EPOCHS):
            for part in np.array_split(order(len(scaled)), max(1, len(scaled) // BATCH)) if scaled else []:
                at = np.concatenate([scaled[i][0] for i in part])
                x = np.concatenate([scaled[i][1] for i in part])
                row = np.repeat(np.arange(len(part)), [len(scaled[i][0]) for i in part])
                y = np.array([scaled[i][2] for i in part])
                margin = np.bincount(row, self.weight[at] * x, len(part)) + self.bias
                error = 1 / (1 + np.exp(-margin)) - y
                touched, back = np.unique(at, return_inverse=True)
                g = np.bincount(back, error[row] * x, len(touched)) / len(part) + L2 * self.weight[touched]
                square[touched] += g * g
                self.weight[touched] -= RATE * g / np.sqrt(square[touched])
                gb = error.mean()
                square_b += gb * gb
                self.bias -= RATE * gb / square_b**0.5

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.weight[features].mean() * 10 + self.bias))))


def vote_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """How often each vote pattern occurs, over all texts."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("int")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in small_batches(batches):
            yield pa.array([pattern(votes(t.as_py())) for t in texts], pa.int32())

    counted = docs.select(code(F.col(text)).alias("code")).groupBy("code").count()
    return {r["code"]: r["count"] for r in counted.collect()}  # at most 3^labellers rows


def fit(docs: DataFrame, text: str = "text", max_training_rows: int = MAX_TRAINING_ROWS) -> tuple[LabelModel, Scorer] | None:
    counts = vote_counts(docs, text)
    n = sum(counts.values())
    if not n:
        return None
    labels = LabelModel(counts)
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1_000_000))
    part = docs if n <= max_training_rows else docs.where(hashed < max(1, int(1_000_000 * max_training_rows / n)))

    @F.arrow_udf("struct<code: int, features: array<int>>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        for texts in small_batches(batches):
            codes, features = [], []
            for t in texts:
                value = t.as_py()
                codes.append(pattern(votes(value)))
                features.append(hasher.features(value).astype("int32"))
            yield pa.StructArray.from_arrays([pa.array(codes, pa.int32()), pa.array(features, pa.list_(pa.int32()))], names=["code", "features"])

    # one row per distinct text, so that a mass of copies does not fill the sample
    sample = part.select(F.coalesce(F.col(text), F.lit("")).alias("t")).distinct().orderBy(F.xxhash64("t")).limit(max_training_rows)
    table = sample.select(described("t").alias("d")).select("d.*").toArrow()
    rows = [(np.array(f), labels.posterior[c]) for c, f in zip(table.column("code").to_pylist(), table.column("features").to_pylist(), strict=True)]
    return labels, Scorer(rows)


def classify_quality(docs: DataFrame, model: tuple[LabelModel, Scorer] | None, text: str = "text", keep_score: float = KEEP_SCORE, into: str = "quality_class") -> DataFrame:
    """``docs`` with a struct column ``into``: score, posterior (of the label model) and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model and (model[0].posterior, model[1]))

    @F.arrow_udf("score double, posterior double, kept boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        posterior, scorer = sent.value
        hasher = kept("hasher", None, Hasher)
        for texts in small_batches(batches):
            values = texts.to_pylist()
            scores = [scorer.score(hasher.features(t)) for t in values]
            soft = [posterior.get(pattern(votes(t))) for t in values]
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(soft, pa.float64()), pa.array([s >= keep_score for s in scores], pa.bool_())], names=["score", "posterior", "kept"])

    return attach(docs, into, run.asNondeterministic()(F.col(text)))
