"""Hierarchical multi-length packing of tokenised documents.

Documents are tokenised, routed to tiers of context sizes (powers of two),
and packed round by round inside a task, a round being about ``round_tokens``
tokens of documents:

1. a document longer than the top tier gives off full top windows; what is
   left of it, and every other document, goes to the smallest tier it fits;
2. going from the longest tier to the shortest, each document of a tier opens
   a window of that size, and the window's gap is filled with the largest
   documents of shorter tiers that fit (best fit), the last gap with a piece
   cut from a document of the shortest tier that has one;
3. windows that shorter documents could not fill wait for the next round; at
   the end of a task what waits is strung together, cut at the top size, and
   the one last sequence of the task is the only one with padding;
4. finished sequences, all a power of two long, are dealt to step groups of
   ``group_tokens`` tokens: among the open groups with room, the one with the
   least attention cost (sum of squared lengths) so far gets the sequence.

A task holds one round of token ids, so memory does not grow with the input;
no shuffle is needed, and a task that is run again makes the same sequences,
since their ids are the task's number and a counter.

Defined cases: a null text counts as empty; an empty text is the end token
alone; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmesh.llm.common import bound_batches, kept

TIERS = (256, 512, 1024, 2048, 4096)
ROUND_TOKENS = 1 << 20
GROUP_TOKENS = 1 << 16
OPEN_GROUPS = 8
#: Strings whose ids a Python worker remembers before it starts anew, some 200 bytes each.
MAX_REMEMBERED = 1_000_000
#: Bytes of text that are tokenised at about a time.
ENCODED_BYTES = 1 << 18
_MARKS = ".,;:!?"
#: Tokenizer settings under which a text's ids are those of its letter runs, lower-cased, and of the signs between.
_WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


class Encoder:
    """Little-endian uint32 ids of whole texts, by a public tokenizer.

    If the vocabulary drops white space and never joins what it parts, a
    text's ids are those of its space-separated strings in turn, so each
    distinct string is tokenised once and remembered.  A string of Latin-1
    letters and closing marks is put together from its lower-cased letters and
    its marks; letters not met before go through the same BPE model in one
    call.  Any other vocabulary gets whole texts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id.to_bytes(4, "little")
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        split = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        suffix = config["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix) and (config.get("normalizer") or {}).get("normalizers") == _WORD_NORMALIZER and split[0] == _WORD_SPLIT
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_word:
            self.ends_word[[i for t, i in config["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_letters(self, fresh: list[str]) -> None:
        ids = np.array(self.model.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        raw = ids.tobytes()
        self.known.update((w, raw[a:b]) for w, a, b in zip(fresh, [0, *cuts], cuts, strict=False))
        if len(cuts) != len(fresh):
            raise ValueError("the vocabulary does not mark the ends of words")

    def _learn(self, fresh: set[str]) -> None:
        made, parts, plain, letters = self.known, [], {}, {}
        for w in fresh:
            core = w.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                low = core.lower()
                if low != w:
                    marks = w[len(core) :]
                    parts.append((w, low, marks))
                    if marks not in made:
                        plain[marks] = None
                if low not in made:
                    letters[low] = None
            else:
                plain[w] = None
        if plain:
            made.update(zip(plain, self._whole(list(plain)), strict=True))
        if letters:
            self._learn_letters(list(letters))
        made.update((w, made[c] + made[m] if m else made[c]) for w, c, m in parts)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id; new strings of all of them are tokenised in one call."""
        if not self.by_word:
            return [ids + self.end for ids in self._whole([t or "" for t in texts])]
        words = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > MAX_REMEMBERED:
            self.known.clear()
        if fresh := set().union(*words).difference(self.known):
            self._learn(fresh)
        ids = self.known.__getitem__
        return [b"".join(map(ids, w)) + self.end for w in words]


class Doc:
    """The tokens of one document from ``start`` to ``end``; its pieces share one buffer of ids."""

    __slots__ = ("key", "whole", "start", "end", "total")

    def __init__(self, key, whole: bytes, start: int, end: int):
        self.key, self.whole, self.start, self.end, self.total = key, whole, start, end, len(whole) // 4

    def __len__(self) -> int:
        return self.end - self.start

    @property
    def ids(self) -> bytes:
        return self.whole[4 * self.start : 4 * self.end]

    def cut(self, n: int) -> Doc:
        """Takes the first n tokens off."""
        head = Doc(self.key, self.whole, self.start, self.start + n)
        self.start += n
        return head


class StepGroups:
    """Deals sequences, all a power of two long, to step groups of equal tokens and like cost."""

    def __init__(self, tokens: int, kept_open: int):
        self.tokens, self.open, self.next = tokens, [], 0
        self.kept_open = kept_open

    def deal(self, length: int) -> int:
        fits = [g for g in self.open if g[1] + length <= self.tokens]
        if not fits or len(self.open) < self.kept_open:
            fits = [[self.next, 0, 0]]
            self.open.append(fits[0])
            self.next += 1
        group = min(fits, key=lambda g: (g[2], g[0]))
        group[1] += length
        group[2] += length * length
        if group[1] >= self.tokens:
            self.open.remove(group)
        return group[0]


class Packer:
    """Packs the documents of one task; ``take`` and ``finish`` return full sequences."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.top = tuple(sorted(tiers)), max(tiers)
        self.waiting: list[Doc] = []
        self.held = 0

    def take(self, doc: Doc) -> list[list[Doc]]:
        full = []
        while len(doc) >= self.top:
            full.append([doc.cut(self.top)])
        if len(doc):
            self.waiting.append(doc)
            self.held += len(doc)
        return full

    def _route(self) -> dict[int, list[tuple[int, int, Doc]]]:
        """Documents by tier, ascending by length (ties: by arrival)."""
        shelves: dict[int, list] = {t: [] for t in self.tiers}
        for i, doc in enumerate(self.waiting):
            shelves[next(t for t in self.tiers if len(doc) <= t)].append((len(doc), i, doc))
        for shelf in shelves.values():
            shelf.sort(key=lambda x: x[:2])
        return shelves

    def round(self) -> list[list[Doc]]:
        shelves = self._route()
        done: list[list[Doc]] = []
        back: list[Doc] = []
        for level in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[level]
            shorter = self.tiers[:level][::-1] if level else (size,)
            while shelves[size]:
                anchor = shelves[size].pop()[2]
                window, gap = [anchor], size - len(anchor)
                for t in shorter:
                    shelf = shelves[t]
                    while gap and (k := bisect_right(shelf, gap, key=lambda x: x[0])):
                        filler = shelf.pop(k - 1)[2]
                        window.append(filler)
                        gap -= len(filler)
                if gap:  # every shorter document left is longer than the gap: cut one
                    t = next((t for t in reversed(shorter) if shelves[t]), None)
                    if t:
                        n, i, doc = shelves[t].pop(0)
                        window.append(doc.cut(gap))
                        insort(shelves[next(s for s in self.tiers if len(doc) <= s)], (len(doc), i, doc), key=lambda x: x[:2])
                        gap = 0
                if gap:
                    back += window
                else:
                    done.append(window)
        self.waiting, self.held = back, sum(map(len, back))
        return done

    def finish(self) -> list[list[Doc]]:
        done = self.round() if self.waiting else []
        window, room = [], self.top
        for doc in self.waiting:
            while len(doc):
                piece = doc.cut(min(room, len(doc)))
                window.append(piece)
                room -= len(piece)
                if not room:
                    done.append(window)
                    window, room = [], self.top
        self.waiting, self.held = [], 0
        return done + [window] if window else done


def _encoder(path: str, end_id: int) -> Encoder:
    return kept("encoder", (path, end_id), lambda: Encoder(path, end_id))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    id_column: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    round_tokens: int = ROUND_TOKENS,
    group_tokens: int = GROUP_TOKENS,
    open_groups: int = OPEN_GROUPS,
) -> DataFrame:
    """One row per piece: id, start, length, token_ids (little-endian uint32), doc_tokens, sequence_id, offset, sequence_tokens, tier, step_group."""
    if any(t & (t - 1) for t in tiers) or group_tokens < max(tiers):
        raise ValueError("tiers must be powers of two, none above group_tokens")
    bound_batches(docs.sparkSession)
    key_type = docs.schema[id_column].dataType
    schema = T.StructType(
        [T.StructField(id_column, key_type), *(T.StructField(n, T.LongType()) for n in ("start", "length")), T.StructField("token_ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, groups = _encoder(tokenizer_path, end_id), Packer(tiers), StepGroups(group_tokens, open_groups)
        base, made = TaskContext.get().partitionId() << 40, 0
        kind = None

        def out(sequences: list[list[Doc]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            cols: list[list] = [[] for _ in schema]
            for window in sequences:
                total = sum(map(len, window))
                tier = next(t for t in packer.tiers if total <= t)
                group, offset = base + groups.deal(tier), 0
                for d in window:
                    for c, v in zip(cols, (d.key, d.start, len(d), d.ids, d.total, base + made, offset, total, tier, group), strict=True):
                        c.append(v)
                    offset += len(d)
                made += 1
            if cols[0]:
                kinds = [kind, pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, values = batch.column(0).to_pylist(), batch.column(1)
            step = max(1, min(len(keys), len(keys) * ENCODED_BYTES // max(1, values.nbytes)))
            for low in range(0, len(keys), step):
                for key, ids in zip(keys[low : low + step], encoder.encode_all(values.slice(low, step).to_pylist()), strict=True):
                    full = packer.take(Doc(key, ids, 0, len(ids) // 4))
                    if full:
                        yield from out(full)
                    if packer.held >= round_tokens:
                        yield from out(packer.round())
        yield from out(packer.finish())

    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, schema)
