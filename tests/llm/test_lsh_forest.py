import random
from itertools import combinations

import numpy as np
import pytest

from inkmesh.llm import lsh_forest as L


def shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, threshold=0.8):
    """Per row: smallest id of its class and number of links, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            degree[i] += 1
            degree[j] += 1
            root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            k = find(i)
            low[k] = min(low.get(k, doc), doc)
    return sorted(((rows[i][0], low.get(find(i)), degree[i]) for i in range(len(rows))), key=repr)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.randrange(30, 150))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(0, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "a b c"), (506, "a b c"), (506, "a b c"), (507, "a  b\nC"), (None, "a b c"), (None, "null id alone here now ok")]
    rows += [(600 + i, "The " * (20 + i)) for i in range(5)]
    rows += [(7, "another text under an id that is taken already by some other row of the table")] * 2
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, class_id string, rep int")
    members, links = L.jaccard_join(docs)
    assert sorted(((r["id"], r["class_id"], r["n_links"]) for r in members.collect()), key=repr) == brute(rows)
    by_id = dict(reversed(rows))
    for r in links.collect():
        if r["a_id"] is not None and r["b_id"] is not None and 7 not in (r["a_id"], r["b_id"]):
            a, b = shingles(by_id[r["a_id"]]), shingles(by_id[r["b_id"]])
            assert r["similarity"] == pytest.approx(len(a & b) / len(a | b)) and r["similarity"] >= 0.8


@pytest.mark.parametrize("broadcast", [True, False])
def test_large_group_is_one_class_with_few_candidates(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(L, "sized_broadcast", lambda df, most=0: df)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, links = L.jaccard_join(docs)
    want = brute(rows)
    got = sorted(((r["id"], r["class_id"]) for r in members.collect()), key=repr)
    # about half of all pairs are links, at or near the threshold; each text has its chances to join
    assert sum(g == w[:2] for g, w in zip(got, want, strict=True)) >= 0.98 * len(rows)
    assert links.count() < 150 * 24  # not all pairs


def test_recall_of_pairs_near_the_threshold(spark):
    rng = random.Random(10)
    rows = []
    for g in range(120):
        w = [f"{g}-{i}" for i in range(120)]
        v = list(w)
        for at in (20, 60)[: 1 + g % 2]:
            v[at] = "changed"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, _ = L.jaccard_join(docs)
    want = {r[0]: r[1] for r in brute(rows)}
    right = sum(r["class_id"] == want[r["id"]] for r in members.collect())
    assert right >= 0.99 * len(rows)


def test_one_per_class(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, str(k), "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, key string, stays_hash string")
    members, _ = L.jaccard_join(docs)
    classes = {r["class_key"]: r["class_id"] for r in members.collect() if r["key"] is not None}
    kept = L.one_per_class(docs, members).collect()
    assert kept[0].__fields__ == docs.columns
    worded = [r["doc_id"] for r in kept if shingles(r["text"])]
    assert sorted(map(repr, worded)) == sorted(map(repr, classes.values()))  # one of each class, its smallest id
    assert len(kept) - len(worded) == sum(not shingles(t) for _, t in rows)  # texts without words all stay
    assert {r["doc_id"] for r in kept} >= {0, 500, 501, 502, 503, 505, 600}
    assert not {r["doc_id"] for r in kept} & {504, 506, 507}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)], "a long, b long")
    got = {r["rep"]: r["root"] for r in L.components(edges, L.shared_dir(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_empty_table_and_prefix_length(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    members, links = L.jaccard_join(docs)
    assert members.count() == 0 and links.count() == 0
    assert L.one_per_class(docs, members).count() == 0
    k = L.prefix_length(0.8, 24, 8, 0.995)
    assert 1 - (1 - 0.8**k) ** 24 >= 0.995 and 1 - (1 - 0.8 ** (k + 1)) ** 24 < 0.995


def test_minhash_estimates_similarity():
    rng = np.random.Generator(np.random.PCG64(1))
    a = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    b = np.concatenate([a[:400], np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))])
    s = L.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.08


def large_group(n, seed, partners=0):
    """Texts of 200 words, 1 to 3 of them changed, at 0.75 to 0.92 of one another, and two further ones of each of ``partners`` texts."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    rows = []

    def changed(words, k):
        w = list(words)
        for _ in range(k):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))
        return w

    for i in range(n):
        changed(base, 1 + i % 3)
    for _ in range(partners):  # similar to one another, hardly to the group
        far = changed(base, 6)
        changed(far, 1)
    return rows


def test_every_link_of_a_large_group_is_counted(spark):
    rows = large_group(300, 11, partners=10)
    docs = spark.createDataFrame([*rows, (5000, rows[7][1])], "doc_id long, text string")
    members, links = L.jaccard_join(docs)
    want = brute([*rows, (5000, rows[7][1])])
    assert sum(w[2] for w in want) > 300 * 100
    assert sorted(((r["id"], r["class_id"], r["n_links"]) for r in members.collect()), key=repr) == want
    pairs = [(r["a_id"], r["b_id"]) for r in links.collect()]
    assert len({frozenset(p) for p in pairs}) == len(pairs)
    copies = 1 + sum(7 in p for p in pairs)
    assert 2 * (len(pairs) + copies) == sum(w[2] for w in want)


def test_a_thousand_near_duplicates_equal_all_pairs(spark):
    rows = large_group(1000, 12, partners=20)
    members, _ = L.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(rows)
    assert sum(w[2] for w in want) > 1000 * 300  # links of the group itself, not a handful
    assert sum(w[2] == 1 for w in want) > 20  # and texts with a single partner
    assert sorted(((r["id"], r["class_id"], r["n_links"]) for r in members.collect()), key=repr) == want
