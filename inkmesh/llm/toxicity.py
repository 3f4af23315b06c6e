"""Toxicity: boosted trees over dense features, with isotonic calibration.

Every text becomes one dense vector: densities of a fixed and of a learned
lexicon, how near their hits stand to second-person words, capitals,
punctuation, and how often words are disguised (digits or signs for letters).
The learned lexicon holds words and word beginnings by their smoothed log-odds
in the labelled texts; a training text's own label is left out of the weights
that it sees.  Histogram gradient-boosted trees are fitted to the vectors, and
pool-adjacent-violators on out-of-fold scores turns margins into
probabilities.

Fitting happens on the driver on at most ``max_training_rows`` labelled texts,
taken by hash of the id; scoring runs over every whole text.

Defined cases: a null text counts as empty, and empty texts get a score like
any other; null labels and labels without a document are ignored; of several
labels of one id the largest counts; with no labels of both kinds every score
is the share of toxic labels (0 if there is none); equal texts get equal
scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.common import attach, fold, kept, small_batches

MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 8000, 64 << 20
#: A learned term needs so many labelled texts, and so high a log-odds.
MIN_SUPPORT, MIN_LOG_ODDS, MAX_TERMS = 4, 2.0, 20_000
PREFIXES = (4, 5, 6, 7)
#: Hits count as addressed if a second-person word stands so near.
NEAR = 6
#: Tokens whose vectors a Python worker remembers, some 300 bytes each.
MAX_REMEMBERED = 150_000

SEED_LEXICON = frozenset(
    """idiot idiots moron morons stupid dumb fool trash garbage scum loser losers pathetic worthless disgusting clown
    imbecile jerk ugly filth filthy vermin pig rat liar coward crap damn hate hateful shut disgrace
    dummkopf trottel abschaum müll versager hässlich dreck arschloch
    imbécile crétin ordure minable dégoûtant connard salaud
    idiota imbécil basura escoria asqueroso estúpido perdedor inútil""".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur ye thou du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
_INNER = re.compile(r"[*._\-#~^'’]+")
_MARKS = "!?.,;:"
_EDGE = "!?.,;:\"'()[]{}<>*_-…«»“”„’`~|/\\"

FEATURES = (
    "seed_density learned_density evidence_density strong_hits weak_hits addressed_share addressed_density second_person_density "
    "letter_capitals shouted_words exclamation_density question_density punctuation_density obfuscated_density mixed_density digit_density mean_word_length log_words"
).split()
#: Columns of a token's own vector.
_SEED, _LEARNED, _EVIDENCE, _SECOND, _UPPER, _LETTERS, _SHOUT, _EXCL, _QUEST, _PUNCT, _OBF, _MIXED, _DIGIT, _LENGTH, _WIDTH = range(15)


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, as keys of the learned lexicon."""
    return [word] + [word[:n] + "~" for n in PREFIXES if len(word) > n]


def plain(token: str) -> str:
    return token.strip(_EDGE).lower()


class Vectorizer:
    """Texts to dense vectors, given a learned lexicon (term to log-odds)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, _WIDTH))

    def _evidence(self, word: str) -> float:
        known, n = self.lexicon.get, len(word)
        best = known(word, 0.0)
        for k in PREFIXES:
            if n <= k:
                break
            best = max(best, known(word[:k] + "~", 0.0))
        return best

    def token_vector(self, token: str) -> list[float]:
        core = token.rstrip(_MARKS)
        if core.isalpha():  # most tokens
            letters, marks = len(core), token[len(core) :]
            upper = 0 if core.islower() else sum(map(str.isupper, core))
            word = core.lower()
            e = self._evidence(word)
            return [word in SEED_LEXICON, e > 0, e, word in SECOND_PERSON, upper, letters, letters >= 3 and upper == letters, marks.count("!"), marks.count("?"), len(marks), 0, 0, 0, len(token)]
        v = [0.0] * _WIDTH
        word = plain(token)
        letters = sum(map(str.isalpha, token))
        upper = sum(map(str.isupper, token))
        digits = sum(map(str.isdigit, token))
        v[_UPPER], v[_LETTERS], v[_LENGTH] = upper, letters, len(token)
        v[_SHOUT] = letters >= 3 and upper == letters
        v[_EXCL], v[_QUEST] = token.count("!"), token.count("?")
        v[_PUNCT] = len(token) - letters - digits
        v[_DIGIT] = digits > 0
        v[_SEED] = word in SEED_LEXICON
        v[_EVIDENCE] = self._evidence(word)
        v[_LEARNED] = v[_EVIDENCE] > 0
        v[_SECOND] = word in SECOND_PERSON
        if word and not word.isalpha() and letters:
            v[_MIXED] = 1
            bare = _INNER.sub("", word.translate(_LEET))
            if bare != word and bare.isalpha() and (bare in SEED_LEXICON or self.lexicon.get(bare, 0.0) > 0):
                v[_OBF], v[_SEED], v[_EVIDENCE] = 1, float(bare in SEED_LEXICON), max(v[_EVIDENCE], self._evidence(bare))
        return v

    def _learn(self, tokens: list[str]) -> None:
        if len(self.index) > MAX_REMEMBERED:
            self.index.clear()
        fresh = [t for t in dict.fromkeys(tokens) if t not in self.index]
        need = len(self.index) + len(fresh)
        if need > len(self.table):
            self.table = np.vstack([self.table, np.zeros((max(need, MAX_REMEMBERED // 4) - len(self.table) + need // 8, _WIDTH))])
        if fresh:
            self.table[need - len(fresh) : need] = [self.token_vector(t) for t in fresh]
            self.index.update(zip(fresh, range(need - len(fresh), need), strict=True))

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Token vectors of one text."""
        try:
            at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            self._learn(tokens)
            at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        rows = self.table[at]
        if len(self.index) > 2 * MAX_REMEMBERED or len(tokens) > MAX_REMEMBERED or max(map(len, tokens)) > MAX_REMEMBERED:  # a very long text or token is not remembered
            self.index.clear()
            self.table = np.zeros((1024, _WIDTH))
        return rows

    def vector(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(len(FEATURES))
        return summed(self.rows(tokens))


def summed(rows: np.ndarray) -> np.ndarray:
    n, total = len(rows), rows.sum(axis=0)
    evidence = rows[:, _EVIDENCE]
    hits = np.flatnonzero((rows[:, _SEED] > 0) | (evidence > 0))
    second = np.flatnonzero(rows[:, _SECOND])
    addressed = 0
    if len(hits) and len(second):
        k = np.searchsorted(second, hits)
        before = np.abs(hits - second[np.maximum(k - 1, 0)])
        after = np.abs(hits - second[np.minimum(k, len(second) - 1)])
        addressed = int((np.minimum(before, after) <= NEAR).sum())
    strong = int((evidence >= 3).sum() + ((rows[:, _SEED] > 0) & (evidence < 3)).sum())
    return np.array(
        [
            total[_SEED] / n, total[_LEARNED] / n, total[_EVIDENCE] / n, math.log1p(strong), math.log1p(len(hits)),
            addressed / max(1, len(hits)), addressed / n, total[_SECOND] / n, total[_UPPER] / max(1, total[_LETTERS]), total[_SHOUT] / n,
            total[_EXCL] / n, total[_QUEST] / n, total[_PUNCT] / n, total[_OBF] / n, total[_MIXED] / n, total[_DIGIT] / n,
            total[_LENGTH] / n, math.log1p(n),
        ]
    )


class Counts:
    """In how many toxic and clean texts each term of a toxic text occurs."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        self.n = [int((labels == 0).sum()), int((labels == 1).sum())]
        self.by: list[Counter] = [Counter(), Counter()]
        for kind in (1, 0):
            known = self.by[1]
            for text in (t for t, y in zip(texts, labels, strict=True) if y == kind):
                terms = {t for w in set(map(plain, text.split())) if w for t in terms_of(w)}
                self.by[kind].update(terms if kind else (t for t in terms if t in known))

    def log_odds(self, term: str, without: int | None = None) -> float:
        """``without``: the class of the one text that is left out."""
        clean, toxic = max(0, self.by[0][term] - (without == 0)), max(0, self.by[1][term] - (without == 1))
        if clean + toxic < MIN_SUPPORT - (without is not None):
            return 0.0
        n0, n1 = self.n[0] - (without == 0), self.n[1] - (without == 1)
        s = math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))
        return s if s >= MIN_LOG_ODDS else 0.0

    def lexicon(self, without: int | None = None) -> dict[str, float]:
        found = {t: s for t in self.by[1] if (s := self.log_odds(t, without))}
        return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:MAX_TERMS])


class Trees:
    """Gradient-boosted trees of fixed depth on binned features, logistic loss."""

    def __init__(self, n_trees: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 32, l2: float = 4.0):
        self.n_trees, self.depth, self.rate, self.bins, self.l2 = n_trees, depth, rate, bins, l2
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        margin = np.full(n, self.base)
        for _ in range(self.n_trees):
            q = 1 / (1 + np.exp(-margin))
            g, h = y - q, q * (1 - q)
            node = np.zeros(n, np.int64)
            features, cuts = [], []
            for level in range(self.depth):
                width_l = 1 << level
                gain_best, f_best, b_best = np.zeros(width_l), np.zeros(width_l, np.int64), np.full(width_l, self.bins)
                for j in range(width):
                    key = node * self.bins + binned[:, j]
                    gl = np.bincount(key, g, width_l * self.bins).reshape(width_l, -1).cumsum(axis=1)
                    hl = np.bincount(key, h, width_l * self.bins).reshape(width_l, -1).cumsum(axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    best = gain.argmax(axis=1)
                    top = gain[np.arange(width_l), best]
                    better = top > gain_best + 1e-9
                    gain_best[better], f_best[better], b_best[better] = top[better], j, best[better]
                cut = np.array([edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(f_best, b_best, strict=True)])
                features.append(f_best)
                cuts.append(cut)
                node = node * 2 + (x[np.arange(n), f_best[node]] > cut[node])
            leaves = np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.l2) * self.rate
            margin += leaves[node]
            self.feature.append(np.concatenate(features))
            self.cut.append(np.concatenate(cuts))
            self.leaf.append(leaves)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and their means, ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, float)
        self.constant: float | None = None
        if len(set(labels)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.0
            self.lexicon: dict[str, float] = {}
            return
        counts = Counts(texts, y)
        self.lexicon = counts.lexicon()
        # a text of class c is seen with weights that lack one text of class c
        views = [Vectorizer(counts.lexicon(c)) for c in (0, 1)]
        x = np.stack([views[int(c)].vector(t) for t, c in zip(texts, y, strict=True)])
        part = np.arange(len(y)) % 4
        margins = np.zeros(len(y))
        for k in range(4):
            inside = part != k
            margins[~inside] = Trees().fit(x[inside], y[inside]).margin(x[~inside])
        self.knots, self.levels = isotonic(margins, y)
        self.trees = Trees().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw probability orders what calibration ties."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        m = self.trees.margin(x)
        return np.clip(0.999 * np.interp(m, self.knots, self.levels) + 0.001 / (1 + np.exp(-m)), 0.0, 1.0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train_where=None,
    max_training_rows: int = MAX_TRAINING_ROWS,
    max_training_bytes: int = MAX_TRAINING_BYTES,
) -> Model:
    """A model from at most ``max_training_rows`` different labelled texts, those of the smallest hashes, and
    of these, in that order, as many as ``max_training_bytes`` allow."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    if train_where is not None:
        known = known.where(train_where)
    known = known.groupBy(id_column).agg(F.max(label).cast("int").alias("__y"))
    n = known.count()
    if n > max_training_rows:
        known = known.where(F.pmod(F.xxhash64(id_column), F.lit(1_000_000)) < int(1_000_000 * max_training_rows / n))
    texts = docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("__t")).join(F.broadcast(known), id_column)  # about max_training_rows ids
    texts = texts.withColumn("__h", F.xxhash64(id_column, "__t"))
    sizes = texts.select("__h", F.octet_length("__t").alias("__n")).distinct().orderBy("__h").limit(max_training_rows).collect()
    total, chosen = 0, []
    for r in sizes:
        total += r["__n"]
        if total > max_training_bytes:
            break
        chosen.append((r["__h"],))
    picked = docs.sparkSession.createDataFrame(chosen, "__h long")
    sample = texts.join(F.broadcast(picked), "__h").select(F.col(id_column).cast("string").alias("i"), F.col("__t").alias("t"), F.col("__y").alias("y")).distinct()
    rows = sorted(tuple(r) for r in sample.collect())
    return Model([r[1] for r in rows], [1 if r[2] else 0 for r in rows])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into``: score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("score double, predicted int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        _, view = kept("toxicity", id(m), lambda: (m, Vectorizer(m.lexicon)))
        for texts in small_batches(batches):
            x = np.stack([view.vector(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))
            s = m.score(x)
            yield pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"), pa.int32())], names=["score", "predicted"])

    return attach(docs, into, run.asNondeterministic()(F.col(text)))


def held_out(id_column: str = "doc_id"):
    return fold(id_column, 3) == 1
