"""Secret scans in DataFrame functions only: fixed patterns and a randomness battery.

Three pattern kinds are always reported: ``assign`` (a key word, a sign, a
value), ``access`` (AKIA key ids) and ``hex`` (long lower-case hex runs).  The
method adds ``random`` spans: maximal runs of token characters of at least
``min_token`` characters that touch no pattern span and that

* look random in their inferred encoding (hex, base32, base36, base62,
  base64): a chi-squared test of uniform symbols with exact moments, a runs
  test about the middle of the alphabet and a lag-1 serial-correlation test,
  joined by Bonferroni, do not reject at ``random_level``;
* are too unlike text: the likelihood ratio of uniform symbols to a text model
  (letter rates, digit and sign rates, case changes) bounds the chance that
  text looks so by ``p = exp(-log ratio)``, since the ratio's mean under text
  is one.  Evidence adds up symbol by symbol, so short tokens need to be
  odder.  Among a text's m tokens the p-values are divided by weights in
  proportion to length and Benjamini-Hochberg keeps the share of false
  discoveries under ``false_discovery_rate``.

Positions are code points, end exclusive.  Defined cases: a null text counts
as empty and has no spans; runs of digits alone are no tokens for the battery;
trailing ``=`` is left out of the tests but is part of the span; equal texts
have equal spans.  Each text is its own family of tests, so nothing is
shuffled and a text's result depends on that text alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.common import attach, unused

MIN_TOKEN = 20
RANDOM_LEVEL = 0.001
FALSE_DISCOVERY_RATE = 1e-4

#: Matches that are placed in one go.
BLOCK = 512

KINDS = ("assign", "access", "hex", "random")
_VALUE = "[A-Za-z0-9+/_.=-]+"
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""" + _VALUE + ")",
    "access": "AKIA[A-Z0-9]{16,}",  # a run starts at its first AKIA, so a least length in the pattern drops the same matches
    "hex": "[0-9a-f]{24,}",
}
MIN_VALUE = 6

#: Rough rates of a to z in text of European languages, in thousandths.
LETTER_RATES = (80, 14, 28, 42, 140, 18, 20, 35, 76, 3, 8, 45, 26, 74, 66, 22, 5, 66, 68, 72, 38, 12, 13, 4, 12, 13)
DIGIT_RATE, SIGN_RATE, CASE_CHANGE = 0.002, 0.005, 0.05
_LOG_TEXT = {chr(97 + i): math.log(0.96 * r / 1000) for i, r in enumerate(LETTER_RATES)} | {d: math.log(DIGIT_RATE) for d in "0123456789"} | {s: math.log(SIGN_RATE) for s in "+/"}
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order they are tried: name, pattern of a run, alphabet, whether case counts.
ENCODINGS = (
    ("hex", "[0-9a-f]+|[0-9A-F]+", _DIGITS + "abcdef", False),
    ("base32", "[A-Z2-7]+", "abcdefghijklmnopqrstuvwxyz234567", False),
    ("base36", "[0-9a-z]+|[0-9A-Z]+", _DIGITS + _LOWER, False),
    ("base62", "[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER, True),
    ("base64", "[0-9A-Za-z+/]+", _UPPER + _LOWER + _DIGITS + "+/", True),
)


_EMPTY = "array<struct<start:int,token:string>>"


def _steps(text: Column, pattern: str, tokens: Column) -> Column:
    """array of struct(gap, token): how far each match starts behind the one before it."""
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(tokens))
    return F.zip_with(pieces, tokens, lambda gap, t: F.struct(F.length(gap).alias("gap"), t.alias("token")))


def _placed(steps: Column, at: Column) -> Column:
    """Steps from position ``at`` on -> array of struct(start, token).

    The array grows by copying, so ``steps`` is kept short; see ``found``.
    """
    return F.aggregate(
        steps,
        F.struct(at.alias("at"), F.array().cast(_EMPTY).alias("out")),
        lambda a, e: F.struct(
            (a["at"] + e["gap"] + F.length(e["token"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + e["gap"]).alias("start"), e["token"].alias("token")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def _placed_in_blocks(steps: Column) -> Column:
    """The same, block by block of ``BLOCK`` steps."""
    cut = F.transform(F.array(steps), lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))[0]
    sized = F.transform(cut, lambda s: F.struct(s.alias("steps"), F.aggregate(s, F.lit(0), lambda n, e: n + e["gap"] + F.length(e["token"])).alias("length")))
    starts = lambda blocks: F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, s: F.struct((a["at"] + s["length"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
        lambda a: a["starts"],
    )
    return F.transform(F.array(sized), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), lambda s, at: _placed(s["steps"], at))))[0]


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of struct(start, token).

    The pieces between the matches give the positions; they are cut only if
    there is a match at all.  Many matches are placed in blocks, each from the
    length of the blocks before it, so that the time stays in proportion.
    """
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        F.array(tokens),
        lambda m: F.when(F.size(m) == 0, F.array().cast(_EMPTY)).when(F.size(m) <= BLOCK, _placed(_steps(text, pattern, m), F.lit(0))).otherwise(_placed_in_blocks(_steps(text, pattern, m))),
    )[0]


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) for z of either sign (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * (1 / math.sqrt(2 * math.pi)) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def _choose(encoding: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(encoding == k, F.lit(v)) if out is None else out.when(encoding == k, F.lit(v))
    return out


def _pairs(x: Column, of) -> Column:
    """``of`` of neighbours in an array of at least two."""
    n = F.size(x)
    return F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), of)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _mark(x: Column) -> Column:
    return x.cast("int").cast("double")


def battery(tokens: Column) -> Column:
    """array of struct(start, token) -> array of struct(start, end, n, encoding, p_text, p_random)."""
    body = F.transform(
        tokens,
        lambda t: F.struct(
            t["start"].alias("start"),
            (t["start"] + F.length(t["token"])).alias("end"),
            F.translate(F.regexp_replace(t["token"], "=+$", ""), "-_=", "+//").alias("b"),
        ),
    )

    def infer(b: Column) -> Column:
        out = None
        for name, pattern, _, _ in ENCODINGS:
            test = b.rlike(f"^(?:{pattern})$")
            out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
        return out

    body = F.filter(body, lambda t: (F.length(t["b"]) >= 2) & ~t["b"].rlike("^[0-9]+$"))
    typed = F.transform(body, lambda t: F.struct(t["start"], t["end"], t["b"].alias("b"), infer(t["b"]).alias("encoding")))
    alphabet = {e[0]: e[2] for e in ENCODINGS}
    sized = F.transform(
        typed,
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), F.length(t["b"]).cast("double").alias("n"),
            _choose(t["encoding"], {k: float(len(v)) for k, v in alphabet.items()}).alias("k"),
            F.filter(F.split(t["b"], ""), lambda c: c != "").alias("chars"),
            _choose(t["encoding"], alphabet).alias("alphabet"), _choose(t["encoding"], {e[0]: e[3] for e in ENCODINGS}).alias("cased"),
        ),
    )
    indexed = F.transform(
        sized,
        lambda t: F.struct(
            *[t[c].alias(c) for c in ("start", "end", "encoding", "n", "k", "cased", "chars")],
            F.transform(t["chars"], lambda c: (F.instr(t["alphabet"], F.when(t["cased"], c).otherwise(F.lower(c))) - 1).cast("double")).alias("x"),
        ),
    )
    log_text = F.create_map(*[F.lit(v) for kv in _LOG_TEXT.items() for v in kv])
    summed = F.transform(
        indexed,
        lambda t: F.struct(
            *[t[c].alias(c) for c in ("start", "end", "encoding", "n", "k", "cased")],
            _sum(F.transform(F.array_distinct(t["x"]), lambda v: F.pow(F.size(F.filter(t["x"], lambda w: w == v)).cast("double"), F.lit(2.0)))).alias("squares"),
            _sum(F.transform(t["x"], lambda v: _mark(v >= t["k"] / 2))).alias("high"),
            (_sum(_pairs(t["x"], lambda a, b: _mark((a >= t["k"] / 2) != (b >= t["k"] / 2)))) + 1).alias("runs"),
            (_sum(t["x"]) / t["n"]).alias("mean"), _sum(F.transform(t["x"], lambda v: v * v)).alias("xx"), _sum(_pairs(t["x"], lambda a, b: a * b)).alias("xy"),
            (F.element_at(t["x"], 1) + F.element_at(t["x"], -1)).alias("ends"),
            _sum(F.transform(t["chars"], lambda c: F.element_at(log_text, F.lower(c)))).alias("log_text"),
            _sum(F.transform(t["chars"], lambda c: _mark(c.rlike("[A-Za-z]")))).alias("letters"),
            _sum(_pairs(t["chars"], lambda a, b: _mark(a.rlike("[A-Z]") & b.rlike("[a-z]") | a.rlike("[a-z]") & b.rlike("[A-Z]")))).alias("changes"),
            _sum(_pairs(t["chars"], lambda a, b: _mark(a.rlike("[A-Za-z]") & b.rlike("[A-Za-z]")))).alias("chances"),
        ),
    )

    def tests(t: Column) -> Column:
        n, k = t["n"], t["k"]
        chi = (k / n * t["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        low = n - t["high"]
        mu = 2 * t["high"] * low / n + 1
        variance = (mu - 1) * (mu - 2) / (n - 1)
        runs = F.when((t["high"] == 0) | (low == 0), F.pow(F.lit(2.0), 1 - n)).when(variance <= 0, F.lit(1.0)).otherwise(two_sided((t["runs"] - mu) / F.sqrt(variance)))
        spread = t["xx"] - n * t["mean"] * t["mean"]
        along = t["xy"] - t["mean"] * (2 * n * t["mean"] - t["ends"]) + (n - 1) * t["mean"] * t["mean"]
        serial = F.when(spread <= 1e-9, F.lit(0.0)).otherwise(two_sided((along / spread + 1 / n) * F.sqrt(n)))
        p_random = F.least(F.lit(1.0), 3 * F.least(upper_tail(chi), runs, serial))
        # symbols under the uniform model; letters of both cases are one symbol of the text model
        uniform = -n * F.log(k) + F.when(t["cased"], t["letters"] * math.log(2)).otherwise(0.0)
        case = F.when(t["cased"], -t["letters"] * math.log(2) - t["changes"] * math.log(CASE_CHANGE) - (t["chances"] - t["changes"]) * math.log(1 - CASE_CHANGE)).otherwise(0.0)
        ratio = uniform - t["log_text"] + case
        return F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), n.alias("n"), F.exp(-F.greatest(F.lit(0.0), F.least(F.lit(700.0), ratio))).alias("p_text"), p_random.alias("p_random")
        )

    return F.transform(summed, tests)


def discoveries(tested: Column, rate: float, random_level: float) -> Column:
    """Weighted Benjamini-Hochberg over one text's tokens, then the randomness condition."""
    m = F.size(tested)
    mean = _sum(F.transform(tested, lambda t: t["n"])) / m
    weighted = F.transform(tested, lambda t: F.struct((t["p_text"] * mean / t["n"]).alias("w"), t.alias("t")))
    order = F.array_sort(F.transform(weighted, lambda t: t["w"]))
    passed = F.filter(F.transform(order, lambda w, i: F.when(w <= rate * (i + 1) / m, w)), lambda w: w.isNotNull())
    limit = F.array_max(passed)
    return F.transform(F.filter(weighted, lambda t: (t["w"] <= limit) & (t["t"]["p_random"] >= random_level)), lambda t: t["t"])


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    min_token: int = MIN_TOKEN,
    random_level: float = RANDOM_LEVEL,
    false_discovery_rate: float = FALSE_DISCOVERY_RATE,
    into: str = "secrets",
) -> DataFrame:
    """``docs`` with a struct column ``into``: ``spans``, sorted by start and kind."""
    names = [unused(docs, f"__{into.lower()}_{k}") for k in ("text", *KINDS, "base")]
    t, assign, access, hexes, random, base = names

    def spans(column: str, kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.transform(F.col(column), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), (s["start"] + F.length(s["token"])).alias("end"), F.lit(kind).alias("kind")))

    out = attach(docs, t, F.coalesce(F.col(text), F.lit("")))
    out = attach(out, assign, F.filter(found(F.col(t), PATTERNS["assign"]), lambda s: F.length(F.regexp_extract(s["token"], PATTERNS["assign"], 1)) >= MIN_VALUE))
    out = attach(out, access, found(F.col(t), PATTERNS["access"]))
    out = attach(out, hexes, found(F.col(t), PATTERNS["hex"]))
    out = attach(out, random, found(F.col(t), "[A-Za-z0-9+/_=-]{%d,}" % min_token))
    out = attach(out, base, F.concat(spans(assign, "assign"), spans(access, "access"), spans(hexes, "hex")))
    free = F.filter(F.col(random), lambda s: ~F.exists(F.col(base), lambda b: (s["start"] < b["end"]) & (s["start"] + F.length(s["token"]) > b["start"])))
    out = attach(out, random, F.when(F.size(random) > 0, battery(free)))
    hits = F.when(F.size(random) > 0, discoveries(F.col(random), false_discovery_rate, random_level))
    added = F.transform(hits, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("random").alias("kind")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    out = attach(out, into, F.struct(F.array_sort(F.concat(F.col(base), F.coalesce(added, none))).alias("spans")))
    return out.drop(*names)


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch covered by spans replaced by ``[secret]``; null stays null."""
    parts = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[secret]")).alias("out"))
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(2147483647))),
    )
    return F.when(F.size(spans) > 0, parts).otherwise(text)
