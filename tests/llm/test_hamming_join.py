"""The Hamming join against all pairs of texts."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from inkmesh.llm import hamming_join as hj

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    k = min(2, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((d, len(sets[i]), low.get(find(i)), d == low.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(df, **sizes):
    return sorted(map(tuple, hj.hamming_join(df, **sizes)[0].collect()), key=repr)


def changed(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus(seed=1, family=70):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(90)]
    texts = [" ".join(changed(rng, base, rng.choice([0.0, 0.02, 0.05, 0.08, 0.12]))) for _ in range(family)]
    passage = [f"p{rng.randrange(4000)}" for _ in range(40)]
    texts += [" ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60)))]) for _ in range(40)]
    texts += [" ".join(f"r{rng.randrange(900)}" for _ in range(rng.randrange(1, 50))) for _ in range(60)]
    texts += ["", None, " \t\n", "One", "one", "ÄB c", "äb c", "a\x1cb c d", "a b c d", "a\x0bb c d", "Two words", "two  WORDS", "x y x y x y"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + rows[:5] + [(None, texts[0]), (None, "only here"), (None, "only here"), (3, "another text of that id")]


@pytest.mark.parametrize("sizes", [{}, {"small": 3, "block": 8}, {"small": 2, "block": 1000}])
def test_equal_to_all_pairs(spark, tmp_path, sizes):
    rows = corpus(len(sizes))
    assert got(spark.createDataFrame(rows, SCHEMA), folder=str(tmp_path), **sizes) == brute(rows)


def test_pairs_within_the_radius_always_share_a_key():
    rng = np.random.default_rng(1)
    radius = hj.CHUNKS * (hj.ERRORS + 1) - 1
    for _ in range(200):
        wrong = np.zeros(hj.CHUNKS * hj.CHUNK, bool)
        wrong[rng.choice(len(wrong), radius, replace=False)] = True
        assert (wrong.reshape(hj.CHUNKS, hj.CHUNK).sum(axis=1) <= hj.ERRORS).any()


def test_keys_name_what_stays_of_a_chunk(spark):
    one = np.arange(10, dtype=np.uint16)
    other = one.copy()
    other[[2, 5, 6]] = 99  # one error in the first chunk, two in the second
    rows = spark.createDataFrame([(one.tobytes(),), (other.tobytes(),)], "s binary").select(hj.index_keys(hj.F.col("s"), 2, 5, 1).alias("k")).collect()
    assert len(rows[0]["k"]) == len(set(rows[0]["k"])) == 10
    assert [a == b for a, b in zip(rows[0]["k"], rows[1]["k"], strict=True)].count(True) == 1


def test_recall_at_the_threshold(spark, tmp_path):
    """Pairs of 0.8 to 0.83, each a component of two."""
    rng = random.Random(8)
    rows, want = [], 0
    while want < 300:
        a = [f"v{rng.randrange(10**6)}" for _ in range(60)]
        b = list(a)
        for at in rng.sample(range(1, 59), 3):
            b[at] = f"v{rng.randrange(10**6)}"
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if 0.8 <= len(x & y) / len(x | y) < 0.83:
            rows += [(2 * want, " ".join(a)), (2 * want + 1, " ".join(b))]
            want += 1
    members = hj.hamming_join(spark.createDataFrame(rows, SCHEMA), folder=str(tmp_path))[0]
    assert members.where("not kept and component_id = id - 1").count() == want


def test_a_thousand_near_copies_are_not_spelled_out(spark, tmp_path):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, base, 0.02))) for i in range(1000)]
    members, links = hj.hamming_join(spark.createDataFrame(rows, SCHEMA), folder=str(tmp_path))
    assert links.count() < 40_000  # of half a million
    assert sorted(map(tuple, members.collect()), key=repr) == brute(rows)


def test_long_texts_and_words(spark, tmp_path):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "a" * 2_100_000 + " b"), (4, "A" * 2_100_000 + " b"), (5, long[: len(long) // 2])]
    assert [(r[0], r[2]) for r in got(spark.createDataFrame(rows, SCHEMA), folder=str(tmp_path))] == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    assert got(spark.createDataFrame([], SCHEMA), folder=str(tmp_path / "a")) == []
    df = spark.createDataFrame([(1, "a b c", 5, "x", b"k"), (2, "a b c", 6, "y", b"l")], SCHEMA + ", id int, rep string, d binary")
    assert got(df, folder=str(tmp_path / "b")) == [(1, 2, 1, True), (2, 2, 1, False)]
