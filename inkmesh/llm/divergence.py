"""Source divergence audit: how far the word rates of a language's sources lie apart.

Two passes over the texts.  The first counts, exactly, in how many documents of
a language each term occurs; terms of at least ``MIN_DOCS`` documents are kept.
The second searches the texts with an Aho-Corasick automaton of the kept terms,
each padded with a delimiter on both sides, and counts occurrences per group (a
language and a source).  Counts above 0 are the postings.  Rates of a term that
a group lacks all equal one number of that group, so sums over all kept terms
follow from the postings and the number of terms: cells of up to
``CELL_TERMS`` terms and two blocks of up to ``CELL_SOURCES`` sources give
partial sums for the pairs of sources.

A text is turned into delimited terms by one table over its UTF-8 bytes: A-Z
become a-z, other ASCII characters become spaces, all else stays.

What is held at once is bounded: a task counts at most ``FLUSH_TERMS`` terms
before it hands them on, and the vocabularies are searched in passes of about
``BLOCK_BYTES`` of terms, each sent to the tasks and dropped again.  Small
vocabularies share a pass; a language's texts are read once for each part of a
divided one.

Arithmetic is exact: rates are whole numbers of billionths, products are
decimals of 38 digits.  A rate is at most 1,000,000,001, so sums of up to nine
thousand million terms fit a long.

Defined cases: null text, lang and source read as ''; a text without terms
still makes its group occur; repeated rows each count; a language without kept
terms has pairs of value 0 and no terms; an empty table gives no rows; ties in
value are ranked by item in UTF-8 order.  Very long texts are searched whole.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.llm.common import bound_batches, materialize, release, shared_dir

MIN_DOCS = 30
SMOOTHING, UNIT = 5, 1_000_000_000
TOP_TERMS = 50
#: Terms that a task counts before it hands its counts on.
FLUSH_TERMS = 1 << 19
#: Bytes of terms in the automata of one pass (some forty times that in each Python worker).
BLOCK_BYTES = 4 << 20
#: Terms and sources of a cell of the pair sums; together they make arrays of 8 MB.
CELL_TERMS, CELL_SOURCES = 2048, 512

_DELIMITED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def delimited(text: bytes | None) -> bytes:
    """The text's terms in turn, between spaces (one or more)."""
    return b" %b " % (text or b"").translate(_DELIMITED)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes | None]]:
    """lang, source and text's bytes of each row."""
    texts = batch.column("text").cast(pa.binary())
    for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
        yield lang, source, text.as_py()


def _cleaned(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    read = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    return docs.select(read(lang, "lang"), read(source, "source"), read(text, "text"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, docs) over all documents, summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, Counter] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, terms in met.items():
                keys = list(terms)
                for low in range(0, len(keys), 1 << 16):
                    part = keys[low : low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[k] for k in part], pa.int64())], names=["lang", "term", "docs"]
                    )
            met.clear()

        for batch in batches:
            for lang, _, text in _rows(batch):
                terms = met.setdefault(lang, Counter())
                before = len(terms)
                terms.update(set(delimited(text).split()))
                held += len(terms) - before
                if held > FLUSH_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def occurrences(rows: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """(lang, source, term, n): occurrences of each language's terms in its texts, per source."""
    packed = {lang: "\n".join(own).encode() for lang, own in terms.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = {lang: own.decode().split("\n") for lang, own in packed.items()}
        automata = {}
        for lang, own in known.items():
            automata[lang] = ahocorasick.Automaton()
            for i, term in enumerate(own):
                automata[lang].add_word(f" {term} ", i)
            automata[lang].make_automaton()
        counts: dict[tuple[str, str], Counter] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["lang", "source", "at", "n"]
                )
            counts.clear()

        for batch in batches:
            for lang, source, text in _rows(batch):
                found = counts.setdefault((lang, source), Counter())
                before = len(found)
                found.update(map(itemgetter(1), automata[lang].iter(delimited(text).decode())))
                held += len(found) - before + (before == 0)
                if held > FLUSH_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    found = rows.where(F.col("lang").isin(list(terms))).mapInArrow(search, "lang string, source string, at int, n long")
    counts = found.groupBy("lang", "source", "at").agg(F.sum("n").alias("n"))
    names = rows.sparkSession.createDataFrame(pa.table({"lang": [lang for lang, own in terms.items() for _ in own], "at": pa.array([i for own in terms.values() for i in range(len(own))], pa.int32()), "term": [t for own in terms.values() for t in own]}))
    return counts.join(F.broadcast(names), ["lang", "at"]).select("lang", "source", "term", "n")  # the names are those of one pass


def _passes(sizes: dict[str, int], most: int) -> list[list[tuple[str, int, int]]]:
    """(lang, part, parts) of the vocabularies, dealt into passes of about ``most`` bytes at most."""
    # parts by hash come out uneven, so those of a divided vocabulary are aimed at half the bound
    units = [(-(-size // parts), lang, part, parts) for lang, size in sizes.items() for parts in [1 if size <= most else -(-2 * size // most)] for part in range(parts)]
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for size, lang, part, parts in sorted(units):
        if not out or size > room or any(x[0] == lang for x in out[-1]):
            out.append([])
            room = most
        out[-1].append((lang, part, parts))
        room -= size
    return out


def postings(rows: DataFrame, kept: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, term, n) of all kept terms (a written table of lang and term), n > 0.

    The driver holds the terms of one pass at a time.
    """
    schema = "lang string, source string, term string, n long"
    sized = kept.groupBy("lang").agg(F.sum(F.octet_length("term") + 3).alias("bytes")).collect()  # a row for a language that has kept terms
    path = f"{folder}/postings"
    rows.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    passes = _passes({r["lang"]: r["bytes"] for r in sized}, block_bytes)
    for units in passes:
        own = functools.reduce(Column.__or__, [(F.col("lang") == lang) & (F.pmod(F.xxhash64("term"), F.lit(parts)) == part) for lang, part, parts in units])
        terms: dict[str, list[str]] = {}
        for r in kept.where(own).toLocalIterator():
            terms.setdefault(r["lang"], []).append(r["term"])
        if terms:
            occurrences(rows, {lang: sorted(own) for lang, own in terms.items()}).write.mode("append").parquet(path)
        if len(passes) > 1:
            release(rows.sparkSession)
    return rows.sparkSession.read.schema(schema).parquet(path)


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), in whole numbers; null without terms."""
    exact = lambda c: c.cast("decimal(20,0)")
    return (F.call_function("div", exact(count + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)"), exact(total + SMOOTHING * terms)) + 1).cast("long")


def _cell_sums(cells: DataFrame) -> DataFrame:
    """(lang, a, b, value): for each cell, and each two different sources of its blocks, the summed difference of rates.

    ``cells`` has lang, cell, source, first (whether it is of the first block),
    second, terms (kept terms of the cell), empty (the source's rate without
    occurrences), and the lists ``at`` and ``p`` of its postings in the cell.
    """

    def run(table: pa.Table) -> pa.Table:
        lang, terms = table["lang"][0].as_py(), table["terms"][0].as_py()
        sources = table["source"].to_pylist()
        rates = np.repeat(table["empty"].to_numpy()[:, None], max(terms, 1), axis=1) if terms else np.zeros((len(sources), 1), np.int64)
        met: dict[str, int] = {}
        for i, (at, p) in enumerate(zip(table["at"].to_pylist(), table["p"].to_pylist(), strict=True)):
            for where, value in zip(at or (), p or (), strict=True):
                rates[i, met.setdefault(where, len(met))] = value
        first, second = (np.flatnonzero(table[c].to_numpy(zero_copy_only=False)) for c in ("first", "second"))
        a, b, value = [], [], []
        for i in first:
            sums = np.abs(rates[second] - rates[i]).sum(axis=1)
            for j, v in zip(second.tolist(), sums.tolist(), strict=True):
                if i != j:
                    a.append(sources[i])
                    b.append(sources[j])
                    value.append(v)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    return cells.groupBy("lang", "cell").applyInArrow(run, "lang string, a string, b string, value long")


def pair_values(groups: DataFrame, kept: DataFrame, rates: DataFrame, cell_terms: int = CELL_TERMS, cell_sources: int = CELL_SOURCES) -> DataFrame:
    """(lang, source, item, value) for each source and each other one of its language.

    ``groups`` has lang, source, terms (kept ones of the language) and empty (a
    term's rate without occurrences); ``kept`` has lang and term; ``rates`` has
    lang, source, term and p.
    """
    spread = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("terms").alias("terms"))
    ceil = lambda c, n: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(n))).cast("int")
    spread = spread.select("lang", ceil("terms", cell_terms // 2).alias("slices"), ceil("sources", cell_sources // 2).alias("blocks"))  # half full, for hashes are uneven
    dealt = groups.join(spread, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    slot = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice")
    lists = rates.join(spread.select("lang", "slices"), "lang").groupBy("lang", "source", slot).agg(F.collect_list(F.struct(F.col("term").alias("at"), "p")).alias("posted"))
    # terms of a slice that no source of a cell has still count, with the rates of empty ones
    whole = kept.join(spread.select("lang", "slices"), "lang").groupBy("lang", slot).agg(F.count("*").cast("int").alias("n_terms"))
    sliced = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sliced = sliced.join(lists, ["lang", "source", "slice"], "left").join(whole, ["lang", "slice"], "left")
    each = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = each.select("*", F.col("block").alias("one"), F.col("other").alias("two"), F.lit(True).alias("first"), (F.col("block") == F.col("other")).alias("second"))
    theirs = each.where("block <> other").select("*", F.col("other").alias("one"), F.col("block").alias("two"), F.lit(False).alias("first"), F.lit(True).alias("second"))
    cells = mine.unionByName(theirs).select(
        "lang", F.struct("slice", "one", "two").alias("cell"), "source", "first", "second", F.coalesce("n_terms", F.lit(0)).alias("terms"), F.coalesce("empty", F.lit(0)).cast("long").alias("empty"), F.col("posted.at").alias("at"), F.col("posted.p").alias("p")
    )
    return _cell_sums(cells).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_bytes: int = BLOCK_BYTES, cell_terms: int = CELL_TERMS, cell_sources: int = CELL_SOURCES, folder: str | None = None
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language, by its distance (summed
    differences of rates, in billionths), the furthest first.  Part ``term``: the
    terms that the source uses more than its language does, the ``top_terms`` first.
    """
    folder = folder or shared_dir(docs.sparkSession)
    rows = _cleaned(docs, text, lang, source)
    kept = materialize(document_frequencies(rows).where(F.col("docs") >= min_docs).select("lang", "term"), folder, "kept")
    found = postings(rows, kept, folder, block_bytes)
    groups = materialize(rows.select("lang", "source").distinct(), folder, "groups")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    known = groups.join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", zero("terms").alias("terms"), zero("total").alias("total"))
    known = materialize(known.withColumn("empty", F.when(F.col("terms") > 0, rate(F.lit(0), F.col("total"), F.col("terms")))), folder, "known")
    rates = materialize(found.join(known, ["lang", "source"]).select("lang", "source", "term", "n", rate(F.col("n"), F.col("total"), F.col("terms")).alias("p")), folder, "rates")
    pairs = pair_values(known, kept, rates, cell_terms, cell_sources)
    by_lang = known.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    whole = rates.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(by_lang, "lang").select("lang", "term", rate(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    terms = rates.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top_terms))
