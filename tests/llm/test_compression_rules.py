import base64
import os
import random
import re

import pytest

from inkmesh.llm import compression_rules as R
from inkmesh.llm import queries as Q

SF = "/root/testdata/sf0.1"

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(text):
    if text is None:
        text = ""
    words = WORD.findall(text)
    repeat = set()
    for i in range(len(words) - 2):
        for k in range(len(words) - 2):
            if i != k and words[i : i + 3] == words[k : k + 3]:
                repeat |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeat)


def prose(rng, n):
    letters = "etaoinshrdlu"
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def cases():
    rng = random.Random(1)
    words = ["a", "b", "c d", "x\ty", "#", "ü ü", "é|", "\x0b", "\x1c", "line\n"]
    out = [None, "", " ", "\n\n", "a b c a b c", "a a a a a", "one\ntwo\none\n\none", "x\r\nx\r\n", "\x85   　"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    return out


def test_base_counts_against_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(cases())] + [(0, "a b", "clash", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string, n_words int")
    got = R.compression_rules(docs).select("doc_id", "text", "rules.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_verdicts(spark):
    rng = random.Random(2)
    noise = base64.b64encode(rng.randbytes(6000)).decode()
    spaced = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))
    half = " ".join(f"row {i % 7} is {i} of it" for i in range(3000))
    texts = {"clean": prose(rng, 400), "long": prose(rng, 30_000), "noise": spaced, "repeats": half, "late": prose(rng, 600) + " " + half}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    kept = {r["doc_id"]: r["rules"]["kept"] for r in R.compression_rules(docs).collect()}
    assert kept == {"clean": True, "long": True, "noise": False, "repeats": False, "late": False}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.compression_rules(docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 99, 100, 149, 150, 151, 1000])
def test_chunks_join_to_the_text(n):
    raw = bytes(i % 251 for i in range(n))
    parts = R.chunks_of(raw, 100)
    assert b"".join(parts) == raw and all(50 <= len(p) < 150 for p in parts[1:])


def test_fitted_bands_reject_what_differs_in_its_length_class(spark):
    rng = random.Random(7)
    clean = {f"c{i}": prose(rng, rng.randrange(60, 900)) for i in range(1500)}
    odd = {f"o{i}": " ".join(w + "&&&" for w in prose(rng, rng.randrange(100, 600)).split()) for i in range(60)}
    docs = spark.createDataFrame([*clean.items(), *odd.items(), *[("copy", clean["c3"])] * 800, ("none", None), ("empty", "")], "doc_id string, text string")
    document_bands, chunk_bands = R.fit_bands(docs)
    assert [b[0] for b in document_bands] == sorted(b[0] for b in document_bands)
    plain = {r["doc_id"]: r["rules"] for r in R.compression_rules(docs).collect()}
    fitted = {r["doc_id"]: r["rules"] for r in R.compression_rules(docs, document_bands=document_bands, chunk_bands=chunk_bands).collect()}
    gone = {i for i, r in fitted.items() if not r["kept"] and not r["base_failed"]}
    assert not any(r["base_failed"] for i, r in fitted.items() if i[0] in "oc") and all(plain[i]["kept"] for i in odd)
    assert len(gone & odd.keys()) > 30, (len(gone & odd.keys()), document_bands[16:28])
    assert len(gone & clean.keys()) < 0.01 * len(clean) and fitted["copy"]["kept"]


def test_fit_of_an_empty_table(spark):
    document_bands, chunk_bands = R.fit_bands(spark.createDataFrame([], "doc_id long, text string"))
    assert chunk_bands == R.CHUNK_BANDS and R.band_of(2000, document_bands) == R.band_of(2000, R.DOCUMENT_BANDS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_the_method_rejects_more_of_low_quality(spark):
    rules = Q.op5_compression_rules(spark, SF).where("not base_failed").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in rules.groupBy("quality", "kept").count().collect()}
    assert n[0, False] > 0.4 * (n[0, False] + n[0, True]) and n.get((1, False), 0) < 0.01 * n[1, True]
