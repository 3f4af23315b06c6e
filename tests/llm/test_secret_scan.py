import math
import random
import re
import string

import pytest

from inkmesh.llm import secret_scan as S

BASE = {"assign": re.compile(S.PATTERNS["assign"], re.ASCII), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def brute_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[1]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def q(z):
    return math.erfc(z / math.sqrt(2)) / 2


def brute_battery(token):
    """p_text and p_random, written out plainly."""
    b = re.sub("=+$", "", token).translate(str.maketrans("-_=", "+//"))
    name, _, alphabet, cased = next(e for e in S.ENCODINGS if re.fullmatch(e[1], b))
    x = [alphabet.index(c if cased else c.lower()) for c in b]
    n, k = len(x), len(alphabet)
    chi = (k / n * sum(x.count(v) ** 2 for v in set(x)) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    h = [v >= k / 2 for v in x]
    n1, n0 = sum(h), n - sum(h)
    mu = 2 * n1 * n0 / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    r = 1 + sum(a != c for a, c in zip(h, h[1:]))
    p_runs = 2.0 ** (1 - n) if not n1 or not n0 else 1.0 if var <= 0 else min(1, 2 * q(abs(r - mu) / math.sqrt(var)))
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    p_serial = 0.0 if spread < 1e-9 else min(1, 2 * q(abs((sum((a - m) * (c - m) for a, c in zip(x, x[1:])) / spread + 1 / n) * math.sqrt(n))))
    p_random = min(1, 3 * min(q(chi), p_runs, p_serial))
    ratio = -n * math.log(k) - sum(S._LOG_TEXT[c.lower()] for c in b)
    if cased:
        letters = sum(c.isalpha() for c in b)
        near = [(a, c) for a, c in zip(b, b[1:]) if a.isalpha() and c.isalpha()]
        changes = sum(a.isupper() != c.isupper() for a, c in near)
        ratio += -changes * math.log(S.CASE_CHANGE) - (len(near) - changes) * math.log(1 - S.CASE_CHANGE)
        ratio += 0 * letters
    return name, math.exp(-max(0, min(700, ratio))), p_random


def brute_spans(text):
    base = brute_base(text)
    tested = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
        bare = re.sub("=+$", "", m[0])
        if len(bare) >= 2 and not bare.isdigit() and not any(m.start() < b[2] and m.end() > b[0] for b in base):
            tested.append((m.start(), m.end(), len(bare), *brute_battery(m[0])))
    if not tested:
        return base
    mean = sum(t[2] for t in tested) / len(tested)
    w = sorted(t[4] * mean / t[2] for t in tested)
    limits = [v for i, v in enumerate(w) if v <= S.FALSE_DISCOVERY_RATE * (i + 1) / len(w)]
    return sorted(base + [(t[0], 3, t[1], "random") for t in tested if limits and t[4] * mean / t[2] <= max(limits) and t[5] >= S.RANDOM_LEVEL])


def texts():
    rng = random.Random(7)
    words = "the quick brown verlängerung constitution donaudampfschifffahrtsgesellschaft getElementByIdentifierFromDocument".split()
    b64 = string.ascii_letters + string.digits + "+/"
    out = [None, "", "a", "AKIA" + "A" * 15, "AKIA" * 9, "0123456789abcdef01234567", "token=abc", "token==abcdef", 'API_KEY : "abcdef.ghi', "password=token:abcdefgh", "Secret='ab12cd", "ß" * 5 + "token = abcdefg"]
    for _ in range(40):
        parts = [rng.choice(words) for _ in range(12)]
        parts.insert(rng.randrange(12), "".join(rng.choice(b64) for _ in range(rng.randrange(20, 60))))
        parts.insert(rng.randrange(12), "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(18, 44))))
        parts.insert(rng.randrange(12), "LAAITIONELLEELLEMENTE" + "4111111111111111" * rng.randrange(2))
        if rng.random() < 0.3:
            parts.insert(3, "passwd: hunter" + str(rng.randrange(10**4)))
        out.append(" \n".join(parts))
    return out + [out[-1], "1" * 50, "ab" * 20, "aB3" * 9 + "==", "=" * 30, "-" * 40]


def test_against_brute_force(spark):
    rows = [(i % 20, t, "x", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, secrets int")
    got = [(r[0], r[1], [tuple(s[c] for c in ("start", "rank", "end", "kind")) for s in r["secrets"]["spans"]]) for r in S.scan_secrets(docs).select("doc_id", "text", "secrets").collect()]
    assert sorted(map(repr, got)) == sorted(repr((r[0], r[1], brute_spans(r[1]))) for r in rows)
    assert sum(s[3] == "random" for g in got for s in g[2]) >= 30  # most base64 tokens are found


def test_sql_equals_brute_force():
    """The oracle's SQL on the same texts."""
    import duckdb
    import pandas as pd

    from inkmesh.llm.secret_scan_sql import secret_scan_sql

    documents = pd.DataFrame({"doc_id": range(len(texts())), "text": texts()})
    con = duckdb.connect()
    con.register("documents", documents)
    got = dict(con.sql(secret_scan_sql()).project("doc_id, spans").fetchall())
    assert [got[i] for i in range(len(got))] == [",".join(f"{k}:{s}:{e}" for s, _, e, k in brute_spans(t)) for t in texts()]


def test_very_many_matches(spark):
    text = "".join(f"ü {i:030x} token=abcdef{i}, " for i in range(5000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [tuple(s[c] for c in ("start", "rank", "end", "kind")) for s in S.scan_secrets(docs).first()["secrets"]["spans"]]
    assert got == brute_base(text) and len(got) == 10_000


def test_text_like_tokens_are_left_alone(spark):
    words = ["donaudampfschifffahrtsgesellschaft", "getElementByIdentifierFromDocument", "LAAITIONELLEELLEMENTE", "some-long-article-title-about-things", "https/example/org/path/to/the/page", "12345678901234567890123", "thenesblereininging"]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert S.scan_secrets(docs).first()["secrets"]["spans"] == []


def test_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, 'x token = "0123456789abcdef01234567" y'), (2, None), (3, "plain")], "doc_id long, text string")
    out = S.scan_secrets(docs)
    got = {r[0]: r[1] for r in out.select("doc_id", S.redacted(out["text"], out["secrets"]["spans"])).collect()}
    assert got == {1: 'x [secret]" y', 2: None, 3: "plain"}
    assert S.scan_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("z", [-3.0, -0.5, 0.0, 0.7, 2.5, 5.0])
def test_normal_tail(spark, z):
    from pyspark.sql import functions as F

    assert abs(spark.range(1).select(S.upper_tail(F.lit(z))).first()[0] - q(z)) < 1e-6
