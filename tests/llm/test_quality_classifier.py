import random
from collections import Counter

import numpy as np
import pytest

from inkmesh.llm import quality_classifier as Q


def test_em_recovers_accuracies():
    """Votes are drawn from known tables; EM must find them from pattern counts alone."""
    rng = np.random.Generator(np.random.PCG64(4))
    n, right = 20_000, np.array([0.9, 0.8, 0.7, 0.95, 0.6])
    good = rng.random(n) < 0.8
    v = np.where(rng.random((n, 5)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    v[rng.random((n, 5)) < 0.3] = 0
    counts = Counter(Q.pattern(list(map(int, r))) for r in v)
    model = Q.LabelModel(counts, n=5)
    assert abs(model.share - 0.8) < 0.03
    assert np.abs(model.accuracy() - right).max() < 0.05
    p = np.array([model.posterior[Q.pattern(list(map(int, r)))] for r in v])
    assert ((p > 0.5) == good).mean() > 0.93


def prose(rng, n):
    return " ".join(rng.choice("the of and house river walked slowly under old trees where children sang".split()) + ("." if rng.random() < 0.12 else "") for _ in range(n))


def corpus():
    rng = random.Random(5)
    good = [prose(rng, rng.randrange(60, 300)) for _ in range(300)]
    bad = ["BUY!! NOW!! " * rng.randrange(30, 80) for _ in range(20)] + ["x | y | & " * rng.randrange(20, 90) for _ in range(20)] + ["spam " * rng.randrange(30, 200) for _ in range(20)] + ["#$%*&<> " * 50 for _ in range(20)]
    return [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]


def test_good_is_kept_and_bad_is_not(spark):
    rows = corpus()
    odd = [(5000, None), (5001, ""), (5002, "same text here"), (5002, "same text here"), (None, "word " * 100_000)]
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(i, t, "x") for i, t in odd], "doc_id long, text string, score string")
    model = Q.fit(table)
    out = Q.classify_quality(table, model).select("doc_id", "text", "quality_class.*").collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert np.mean([by[i]["kept"] == bool(y) for i, _, y in rows]) > 0.97
    assert np.mean([by[i]["kept"] for i, _, y in rows if y]) > 0.99
    assert by[5000]["score"] == by[5001]["score"]
    assert len({r["score"] for r in out if r["doc_id"] == 5002}) == 1


def test_counts_cover_all_rows_and_sample_is_bounded(spark):
    rows = corpus()
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert Q.vote_counts(table) == dict(Counter(Q.pattern(Q.votes(t)) for _, t, _ in rows))
    labels, scorer = Q.fit(table, max_training_rows=100)
    assert np.abs(scorer.weight).sum() > 0 and len(labels.posterior) > 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.fit(empty) is None and Q.classify_quality(empty, None).count() == 0


@pytest.mark.parametrize("text", [None, "", " ", "a", "!!!", "ü" * 1000, "\n\n\n", "a\tb"])
def test_votes_of_odd_texts(text):
    v = Q.votes(text)
    assert len(v) == len(Q.LABELLERS) and set(v) <= {-1, 0, 1} and Q.unpack(Q.pattern(v)) == v
