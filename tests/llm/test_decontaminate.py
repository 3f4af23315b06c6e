import hashlib
import random
import re

from inkmesh.llm import decontaminate as D

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def brute(text, items, size):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        m = min(size, len(v))
        for k in range(len(v) - m + 1 if m else 0):
            for s in range(len(w) - m + 1):
                if w[s : s + m] == v[k : k + m]:
                    hit |= set(range(s, s + m))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def data():
    rng = random.Random(4)
    vocab = ["a", "b", "B", "ü", "É", "c1", "x-y", "the"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 8, 13])))) for i in range(14)]
    items += [(3, items[3][1]), (99, None), (100, "..."), (None, "only null id here"), (None, None), (10, "tie tie tie tie tie tie"), (2, "tie tie tie tie tie tie")]
    docs = [(i, " ".join(rng.choice(vocab + ["z", "tie"]) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!!"), (103, "x " * 500 + "only NULL id, here!"), (104, "y"), (104, "y"), (None, "tie " * 9), (105, "A b\nB-Ü " * 2000)]
    return items, docs


def check(spark, **options):
    items, docs = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(i, t, 7, "c") for i, t in docs], "doc_id long, text string, decontamination int, n_hit string")
    out = D.decontaminate(table, bench, window=6, **options).select("doc_id", "text", "decontamination.*").collect()
    assert len(out) == len(docs)
    for r in out:
        n, hit, found, bad = brute(r["text"], items, 6)
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == (n, hit, found, bad), r["text"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == hit
        assert hashlib.sha256(",".join(found).encode()).hexdigest()


def test_against_brute_force(spark):
    check(spark)


def test_benchmark_in_many_blocks(spark):
    check(spark, max_broadcast_bytes=400)


def test_long_windows_and_shifts():
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(12)]
    items = [(str(i), " ".join(rng.choice(vocab) for _ in range(30)).encode()) for i in range(20)]
    matcher = D.Matcher(items, 13)
    for _ in range(50):
        w = [rng.choice(vocab + ["q"]).encode() for _ in range(120)]
        at = rng.randrange(60)
        w[at : at + 20] = items[rng.randrange(20)][1].split()[:20]
        spans, found = matcher.scan(w)
        n, hit, want, _ = brute(b" ".join(w).decode(), [(i, t.decode()) for i, t in items], 13)
        assert sum(e - s for s, e in spans) == hit and sorted(found) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, none).first()["decontamination"]["contaminated"] is False
    assert D.decontaminate(docs.limit(0), none).count() == 0
