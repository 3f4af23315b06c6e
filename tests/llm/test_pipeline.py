"""Each stage of the pipeline against a brute-force version, on its own input."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as C
from inkmesh.llm import decontaminate as D
from tests.llm.test_lsh_forest import shingles
from tests.llm.test_secret_scan import brute_spans

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(rng):
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "lu"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    item = [word() for _ in range(40)]
    for i in range(260):
        w = [word() for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron"]))
        if i % 17 == 3:
            w[5:5] = item[:25]
        if i % 13 == 1:
            w.insert(7, 'token = "0123456789abcdef0123456789abcdef"')
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    for i in range(20):
        w = docs[i * 7][1].split()
        w[i % len(w)] = "changed" if i % 2 else w[i % len(w)]
        docs.append((1000 + i, " ".join(w)))
    docs += [(2000, None), (2001, ""), (2002, "x"), (2002, "x"), (None, "null id"), (2003, "word " * 40_000), (5, "other text of a known id")]
    rows = [(i, t, None if k % 5 == 0 else "en", "s" if k % 3 else None, None if t is None else len(t)) for k, (i, t) in enumerate(docs)]
    return rows, labels, [(1, " ".join(item)), (2, None), (3, "short item")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels, bench = tables(random.Random(11))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def held(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]

    before, after = seen["toxicity"]
    insults = lambda t: len(re.findall("idiot|scum|moron", t or ""))
    gone = held(before) - held(after)
    assert held(after) - held(before) == Counter()
    assert all(insults(t) for _, t, _, _ in gone)  # clean documents are left alone
    assert sum(insults(t) > 0 for _, t, _, _ in held(after)) <= 3

    before, after = seen["ngram_jaccard_join"]
    rows, kept = list(held(before).elements()), held(after)
    assert kept - held(before) == Counter()
    sets = [shingles(r[1]) for r in rows]
    similar = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b)
    for i, (r, s) in enumerate(zip(rows, sets, strict=True)):
        peers = [p for k, (p, q) in enumerate(zip(rows, sets, strict=True)) if k != i and similar(s, q)]
        if not peers:
            assert r in kept  # what resembles nothing stays
    left = [shingles(r[1]) for r in kept.elements()]
    assert not any(similar(a, b) for i, a in enumerate(left) for b in left[:i])

    before, after = seen["benchmark_decontamination"]
    matcher = D.Matcher([(str(r["item_id"]), (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()], 13)
    want = Counter()
    for r, n in held(before).items():
        words = D.words_of((r[1] or "").encode())
        hit = sum(e - s for s, e in matcher.scan(words)[0])
        if not (hit and 20 * hit >= len(words)):
            want[r] += n
    assert held(after) == want and sum(want.values()) < before.count()

    before, after = seen["secret_scan"]
    want = Counter()
    for r, n in held(before).items():
        out, at = "", 0
        for start, _, end, _ in brute_spans(r[1]):
            if start >= at:
                out += r[1][at:start] + "[secret]"
            at = max(at, end)
        want[(r[0], r[1] if not at else out + r[1][at:], *r[2:])] += n
    assert held(after) == want and any("[secret]" in (t or "") for _, t, _, _ in want)
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = seen["packing"]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(C.public_tokenizer())
    assert sum(r["length"] for r in after.collect()) == sum(len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect())


def test_run_applies_all_stages(spark, sf_dir):
    assert 4 <= len(C.STAGES) <= 5
    out = C.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "sequence_id", "token_ids"} <= set(out.columns)


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_clashing_columns(spark, sf_dir):
    docs = spark.createDataFrame([(i, f"some words number {i} " * 30, "en", "s", 5, "kept", 1.5, i) for i in range(6)], SCHEMA + ", score string, n_words double, rep long")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and {r["score"] for r in out.collect()} == {"kept"}
