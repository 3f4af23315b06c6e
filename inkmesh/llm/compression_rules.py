"""Quality rules by compression bands.

Base rules count words, symbols, repeated lines and repeated three-word
windows.  The method proper compresses the whole text, and each chunk of
``chunk_bytes`` of it, with Zstandard and compares ``compressed / raw`` with a
band that depends on the length: a ratio below the band means repetitive text,
one above it text that does not compress like prose (random or encoded data).
Chunks find a bad stretch inside a long document whose overall ratio is fine:
the text fails when more than ``max_bad_chunks`` of its chunks leave the band.

``fit_bands`` takes the bands from the corpus: over all texts that pass the base
rules, equal ones once, the median ratio of each length class (lengths from one
power of the square root of two to the next), less ``LOW`` and plus ``HIGH``
standard deviations as told from the quartiles; the same of the chunks of full
length.  A class of fewer than
``MIN_CLASS`` texts has the fixed bands, which also serve where nothing is fitted.

Defined cases: null and empty texts have no words, fail the base rules and are
not kept (their ratio is null); equal texts get equal rows; a chunk shorter
than half of ``chunk_bytes`` at the end of a text belongs to the chunk before
it.  Texts of any length are read whole; an empty table has no rows and the
fixed bands; a column named as ``into`` is replaced, others pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.common import attach, bound_batches, small_batches

#: (up to so many bytes, least ratio, greatest ratio) of a whole text, level 3.
#: Short texts compress less, so the band moves down and widens with length.
DOCUMENT_BANDS = ((512, 0.40, 0.90), (1024, 0.35, 0.82), (4096, 0.28, 0.75), (16384, 0.24, 0.70), (65536, 0.20, 0.68), (1 << 62, 0.16, 0.66))
#: The same for single chunks.
CHUNK_BANDS = ((1024, 0.30, 0.90), (1 << 62, 0.22, 0.75))
CHUNK_BYTES = 512
MAX_BAD_CHUNKS = 0.25
#: Standard deviations that the fitted bands reach below and above the median, the least that counts as one,
#: and texts (or chunks) that a fit takes.
LOW, HIGH, LEAST_DEVIATION, MIN_CLASS = 4.0, 5.0, 0.003, 100
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LEVEL = 3
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes.split() parts at exactly x20, x09-x0D
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            covered = 0  # words up to here are counted already
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += i + 3 - max(i, covered)
                    covered = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def band_of(size: int, bands) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if size <= most)


def chunks_of(raw: bytes, size: int) -> list[bytes]:
    cuts = list(range(0, max(1, len(raw)), size))
    if len(cuts) > 1 and len(raw) - cuts[-1] < size // 2:
        cuts.pop()
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def compressor():
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress


def ratios(raw: bytes, chunk_bytes: int, compress) -> tuple[float | None, list[tuple[int, float]]]:
    """Ratio of the whole text, and size and ratio of each chunk."""
    if not raw:
        return None, []
    parts = chunks_of(raw, chunk_bytes)
    whole = len(compress(raw)) / len(raw)
    return whole, [(len(raw), whole)] if len(parts) == 1 else [(len(p), len(compress(p)) / len(p)) for p in parts]


def base_fails(n_words: int, n_repeat_words: int, min_words: int, max_repeat_percent: int) -> bool:
    return n_words < min_words or 100 * n_repeat_words > max_repeat_percent * n_words


def fit_bands(
    docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT
) -> tuple[list[tuple[int, float, float]], list[tuple[int, float, float]]]:
    """Bands of whole texts and of chunks, from all texts.

    The ratios are rounded to four places, so the quartiles are exact at a
    bounded cost; a row for each length class reaches the driver.
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf("size int, ratio double, chunks array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compress = compressor()
        for texts in small_batches(batches):
            rows = []
            for value in texts:
                t = value.as_py()
                n, _, _, _, repeat = base_counts(t)
                if base_fails(n, repeat, min_words, max_repeat_percent):
                    rows.append((None, None, None))
                else:
                    whole, parts = ratios(raw := t.encode(), chunk_bytes, compress)
                    rows.append((len(raw), whole, [r for size, r in parts if size == chunk_bytes] if len(parts) > 1 else []))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=["size", "ratio", "chunks"])

    each = docs.select(measured(F.col(text)).alias("m")).select("m.*").where("size > 0").groupBy("size", "ratio").agg(F.first("chunks").alias("chunks"))
    kind = F.floor(2 * F.log2("size")).cast("int")
    values = F.concat(F.array(F.struct(kind.alias("class"), F.col("ratio").alias("r"))), F.transform("chunks", lambda r: F.struct(F.lit(-1).alias("class"), r.alias("r"))))
    stats = each.select(F.inline(values)).groupBy("class").agg(F.count("*").alias("n"), F.percentile(F.round("r", 4), [0.25, 0.5, 0.75]).alias("q"))
    bands, chunks = {}, CHUNK_BANDS
    for r in stats.where(F.col("n") >= MIN_CLASS).collect():
        low, middle, high = r["q"]
        deviation = max((high - low) / 1.349, LEAST_DEVIATION)
        band = (middle - LOW * deviation, middle + HIGH * deviation)
        if r["class"] < 0:
            other = lambda size: (size, *band_of(size, CHUNK_BANDS))
            chunks = [other(chunk_bytes - 1), (chunk_bytes, *band), other(2 * chunk_bytes), CHUNK_BANDS[-1]]
        else:
            bands[r["class"]] = band
    fitted = [(math.ceil(2 ** ((k + 1) / 2)) - 1, *(bands.get(k) or band_of(math.ceil(2 ** (k / 2)), DOCUMENT_BANDS))) for k in range(62)]
    return [*fitted, DOCUMENT_BANDS[-1]], chunks


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def compression_rules(
    docs: DataFrame,
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    max_bad_chunks: float = MAX_BAD_CHUNKS,
    document_bands=DOCUMENT_BANDS,
    chunk_bands=CHUNK_BANDS,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    into: str = "rules",
) -> DataFrame:
    """``docs`` with a struct column ``into`` of counts, ratios and the verdict ``kept``."""

    @F.arrow_udf(_RESULT)
    def rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compress = compressor()
        for texts in small_batches(batches):
            rows = []
            for value in texts:
                t = value.as_py()
                n, chars, symbols, dup, repeat = base_counts(t)
                failed = base_fails(n, repeat, min_words, max_repeat_percent)
                raw = t.encode() if t else b""
                whole, parts = ratios(raw, chunk_bytes, compress)
                bad = sum(not low <= r <= high for (low, high), r in ((band_of(size, chunk_bands), r) for size, r in parts))
                kept = not failed
                if kept:
                    low, high = band_of(len(raw), document_bands)
                    kept = low <= whole <= high and (len(parts) == 1 or bad <= max_bad_chunks * len(parts))
                rows.append((n, chars, symbols, dup, repeat, failed, whole, len(parts), bad, kept))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _RESULT.split(", ")])

    return attach(docs, into, rules.asNondeterministic()(F.col(text)))
