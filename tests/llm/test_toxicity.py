import random
import zlib

import numpy as np

from inkmesh.llm import toxicity as T


def corpus(n=900, seed=3):
    """Clean and insulting texts in an invented language; insults are words and stems the model must learn."""
    rng = random.Random(seed)
    syll = ["ta", "ri", "mo", "ne", "lu", "sha", "ko", "ve"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(15, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                bad = rng.choice(["idiot", "zorgon" + rng.choice(syll), "you scum", "krexx", "1d1ot"])
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, int(toxic)))
    return rows, labels


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"))
    n1 = sum(y)
    return (sum(r + 1 for r, v in zip(order, y) if v) - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus()
    table = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, predicted int")
    marks = spark.createDataFrame([(i, y, 1) for i, y in labels] + [(None, 1, 1), (5, None, 1), (10**6, 1, 1)], "doc_id long, toxic int, quality int")
    model = T.fit(table, marks, train_where=~T.held_out())
    out = T.score_toxicity(table, model).select("doc_id", T.held_out().alias("held"), "toxicity.*").collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    held = [r for r in out if r["held"] and r["doc_id"] in truth]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    y = [truth[r["doc_id"]] for r in held]
    assert auc(y, [r["score"] for r in held]) > 0.97
    wrong = sum(r["predicted"] != v for r, v in zip(held, y))
    assert wrong <= 0.05 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)


def test_scores_do_not_see_held_out_labels(spark):
    rows, labels = corpus(300)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    scores = []
    for marks in (labels, flipped):
        model = T.fit(table, spark.createDataFrame(marks, "doc_id long, toxic int"), train_where=~T.held_out())
        scores.append(T.score_toxicity(table, model).select("doc_id", "toxicity.score").collect())
    assert scores[0] == scores[1]


def test_odd_rows(spark):
    rows, labels = corpus(300)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "x" * 300_000), (1004, "idiot " * 20_000), (1005, "same"), (1005, "same"), (None, "!!! ??? ***")]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string")
    model = T.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"), max_training_rows=100)
    out = T.score_toxicity(table, model).select("doc_id", "toxicity.*").collect()
    assert len(out) == len(rows + odd) and all(r["score"] is not None for r in out)
    same = [r["score"] for r in out if r["doc_id"] == 1005]
    empty = [r["score"] for r in out if r["doc_id"] in (1000, 1001, 1002)]
    assert same[0] == same[1] and len(set(empty)) == 1


def test_empty_tables_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score_toxicity(docs, T.fit(docs, none)).first()["toxicity"]["score"] == 0.0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert T.score_toxicity(docs, T.fit(docs, one)).first()["toxicity"]["predicted"] == 1
    assert T.score_toxicity(docs.limit(0), T.fit(docs, one)).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.Generator(np.random.PCG64(5))
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    knots, levels = T.isotonic(s, y)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()


def test_features_of_a_known_text():
    v = dict(zip(T.FEATURES, T.Vectorizer({}).vector("You are an IDIOT !! 1d1ot"), strict=True))
    assert v["obfuscated_density"] == 1 / 6 and v["addressed_share"] == 1.0 and v["shouted_words"] == 1 / 6 and v["exclamation_density"] == 2 / 6
