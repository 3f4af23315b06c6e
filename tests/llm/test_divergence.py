"""Source divergence against sums over all kept terms."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from inkmesh.llm import divergence as dv

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def terms_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs, top=dv.TOP_TERMS):
    docs, count = defaultdict(Counter), defaultdict(Counter)
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    for t, lang, s in rows:
        docs[lang].update(set(terms_of(t)))
        count[lang, s].update(terms_of(t))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in docs.items()}

    def rates(lang, c):
        v, n = len(kept[lang]), sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept[lang]}

    p = {g: rates(g[0], c) for g, c in count.items()}
    q = {lang: rates(lang, sum((c for g, c in count.items() if g[0] == lang), Counter())) for lang in kept}
    out = set()
    for lang, s in p:
        pairs = [(-sum(abs(p[lang, s][t] - p[lang, o][t]) for t in kept[lang]), o.encode()) for g, o in p if g == lang and o != s]
        words = [(q[lang][t] - p[lang, s][t], t.encode()) for t in kept[lang] if count[lang, s][t] and p[lang, s][t] > q[lang][t]]
        out |= {(lang, s, "pair", i.decode(), -v, r + 1) for r, (v, i) in enumerate(sorted(pairs))}
        out |= {(lang, s, "term", i.decode(), -v, r + 1) for r, (v, i) in enumerate(sorted(words)[:top])}
    return out


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    words = ["Apple", "pear", "ÄRGER", "ärger", "naïve", "日本", "don't", "a1b", "x", "Fig", "kiwi", "lime"]
    rows = [(i, " ".join(rng.choice(words[: rng.randrange(1, 13)]) for _ in range(rng.randrange(1, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "S3", None])) for i in range(n)]
    rows += [(n, None, "en", "empty"), (n + 1, "12 !?", "xx", "s1"), (n + 2, "rare", "xx", "s2"), (n + 3, "apple\x00pear\tapple  " * 5000, "de", "s2"), (None, "apple", "de", "s9")]
    return rows + rows[:7]


def result(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("block", "cell_terms", "cell_sources"), [(dv.BLOCK_BYTES, dv.CELL_TERMS, dv.CELL_SOURCES), (24, 4, 2), (100, 2, 4)])
def test_equal_to_sums_over_all_terms(spark, tmp_path, block, cell_terms, cell_sources):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = dv.source_divergence(df, min_docs=20, block_bytes=block, cell_terms=cell_terms, cell_sources=cell_sources, folder=str(tmp_path))
    assert result(got) == brute(rows, 20)


def test_counts_handed_on_early_are_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dv, "FLUSH_TERMS", 3)
    rows = corpus(2, 80)
    got = dv.source_divergence(spark.createDataFrame(rows, SCHEMA), min_docs=9, top_terms=2, folder=str(tmp_path))
    assert result(got) == brute(rows, 9, top=2)


def test_without_kept_terms_pairs_have_no_distance(spark, tmp_path):
    rows = [(1, "a", "en", "x"), (2, "b", "en", "y"), (3, None, None, None)]
    assert result(dv.source_divergence(spark.createDataFrame(rows, SCHEMA), folder=str(tmp_path))) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_ties_are_ranked_in_utf8_order(spark, tmp_path):
    rows = [(i, "\U0001f600 Ａ z", "en", "x") for i in range(3)] + [(9, "q q q", "en", "y")]
    got = {r["item"]: r["rank"] for r in dv.source_divergence(spark.createDataFrame(rows, SCHEMA), min_docs=3, folder=str(tmp_path)).where("part = 'term'").collect()}
    assert got == {}  # all kept terms have the rate of the language
    rows += [(10, "\U0001f600 Ａ z q", "en", "z")]
    ranked = [(r["source"], r["item"], r["rank"]) for r in dv.source_divergence(spark.createDataFrame(rows, SCHEMA), min_docs=2, folder=str(tmp_path / "b")).where("part = 'term' and source = 'x'").collect()]
    assert sorted(ranked, key=lambda r: r[2]) == [("x", "z", 1), ("x", "Ａ", 2), ("x", "\U0001f600", 3)]


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    assert dv.source_divergence(spark.createDataFrame([], SCHEMA), folder=str(tmp_path / "a")).count() == 0
    rows = corpus(3, 60)
    df = spark.createDataFrame([(*r, "t", 1, 2.0) for r in rows], SCHEMA + ", term string, rank int, value double")
    assert result(dv.source_divergence(df, min_docs=8, folder=str(tmp_path / "b"))) == brute(rows, 8)
