import random
import zlib

import numpy as np
import pytest

from inkmesh.llm import langid as G


def brute_phrases(text, sample):
    """Greedy cross-parsing by substring search."""
    count = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        count += 1
    return count


def as_text(points):
    return "".join(chr(p) if p else " " for p in points)


def samples():
    return {"aa": ["the cat sat on the mat, the dog ran over the hill"], "bb": ["der hund lief über den berg und die katze saß da"], "cc": ["xyzzy plugh xyzzy"]}


def test_phrases_equal_substring_search():
    rng = random.Random(1)
    identifier = G.Identifier(samples())
    bases = [as_text(G.letters(samples()[k][0] + " ")) for k in identifier.names]
    texts = ["".join(rng.choice("the cat über hund xyz q.,1") for _ in range(rng.randrange(1, 90))) for _ in range(80)]
    texts = [t for t in texts if G.letters(t).any()] + ["t", "ß", "the cat " * 200]
    for few in (0, 10_000):
        G.FEW, old = few, G.FEW
        try:
            got = identifier.phrases([G.letters(t) for t in texts])
        finally:
            G.FEW = old
        for t, row in zip(texts, got, strict=True):
            known = as_text(G.letters(t))
            for k, base in enumerate(bases):
                assert row[k] == max(1, brute_phrases(known, base)), (t, identifier.names[k])


def corpus():
    rng = random.Random(2)
    alphabets = {"x1": ["ba", "ko", "mi"], "x2": ["thr", "ing", "ea"], "x3": ["über", "sch", "ko"], "x4": ["日本", "語", "の"]}
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(alphabets))
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    odd = [(900, None, "x1"), (901, "", "x1"), (902, "123 !?", None), (903, "bakomi " * 30_000, None), (904, "ω", "x2"), (905, "ba ko", None), (905, "ba ko", None), (None, "thring", "x9")]
    table = spark.createDataFrame([(*r, 5) for r in rows + odd], "doc_id long, text string, lang string, score int")
    learned = G.learn(table, train_where=~G.held_out())
    assert "x9" not in learned
    out = G.identify_language(table, learned).select("doc_id", G.held_out().alias("held"), "language.*").collect()
    assert len(out) == len(rows + odd)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["held"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    held = [(i, lang) for i, _, lang in rows if by[i]["held"]]
    assert sum(by[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held)
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "x1"] and by[900]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out)


def test_learning_leaves_held_out_rows_out(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(i, t[::-1] if zlib.crc32(str(i).encode()) % 4 == 2 else t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    assert G.learn(table, train_where=~G.held_out()) == G.learn(mixed, train_where=~G.held_out())


def test_sample_is_bounded(spark):
    table = spark.range(5000).selectExpr("id AS doc_id", "concat('ba', id) AS text", "'x' AS lang")
    assert len(G.learn(table, docs_per_language=8)["x"]) <= 8


@pytest.mark.parametrize("rows", [[], [(1, "hello", "en")]])
def test_nothing_to_learn(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r["language"]["lang_pred"] for r in G.identify_language(table, {}).collect()] == ["und"] * len(rows)


def test_letters():
    assert as_text(G.letters("A1b-- Ç\U0001f600\U00010400")) == "a b ç 𐐨"
    assert not G.letters("12 ").any() and len(G.letters("")) == 0
    assert isinstance(G.letters("x"), np.ndarray)


def test_scripts_beyond_the_alphabet_and_the_first_plane_are_told_apart():
    rng = random.Random(3)
    script = lambda first, n: [chr(first + k) for k in range(n)]
    alphabets = {"cuneiform": script(0x12000, 300), "hieroglyphs": script(0x13000, 300), "han": script(0x4E00, 600), "yi": script(0xA000, 600)}
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    made = G.Identifier({k: [text(v, 80) for _ in range(20)] for k, v in alphabets.items()})
    for k, v in alphabets.items():
        assert made.identify([text(v, 30) for _ in range(50)])[0] == [k] * 50
