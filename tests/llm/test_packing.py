import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkmesh.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    None, "", " ", "\n\t ", "Hello, World!", "it's you'll we've 'tis", "x" * 5000, "Straße ÄÖÜ ñandú É́ é", "a b c\x1cd\x85e", "<|endoftext|> and <|startoftext|>x",
    "İstanbul ΑΣ σς", "日本語 テキスト 123 4.5", "…!!?? --- ...", "don't. stop's!", "µ ª º ß.", "\U0001f600 smile﻿", "a.b,c;d", "N°5 ½ ²",
]


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    encoder = P.Encoder(PATH, 2)
    assert encoder.by_word
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice([t for t in ODD if t] + ["Thing", "thing,", "The", "eau."]) for _ in range(60)) for _ in range(50)]
    for t in texts + texts:
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == want


def test_other_vocabularies_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = P.Encoder(path, 5)
    assert not encoder.by_word
    t = "Hello  there,\n you"
    assert np.frombuffer(encoder.encode(t), "<u4").tolist() == [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 5]


def check(rows, texts_by_id):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in texts_by_id:
        want[i].append(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["start"], r["length"], bytes(r["token_ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append(r)
        assert len(r["token_ids"]) == 4 * r["length"] > 0
    for i, docs in want.items():
        pieces = sorted(got[i])
        if len(docs) == 1:
            at = 0
            for start, length, _, total in pieces:
                assert start == at and total == len(docs[0]) // 4
                at += length
            assert b"".join(p[2] for p in pieces) == docs[0]
        else:  # repeated ids: every document's tokens are there
            assert sum(p[1] for p in pieces) == sum(len(d) // 4 for d in docs)
            for start, length, ids, total in pieces:
                assert any(len(d) // 4 == total and d[4 * start : 4 * (start + length)] == ids for d in docs)
    assert set(got) == set(want)
    padding = used = 0
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in s)
        assert [r["offset"] for r in s] == np.cumsum([0, *[r["length"] for r in s]])[:-1].tolist()
        assert total <= 4096 and all(r["sequence_tokens"] == total for r in s)
        used += total
        padding += 0 if total & (total - 1) == 0 else 4096 - total
    return used, padding, sequences


@pytest.mark.parametrize("parts", [1, 3])
def test_every_id_in_one_piece(spark, parts):
    rng = random.Random(5)
    words = "the Thing of Übermut y que, été. not seen-before 42".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(int(rng.lognormvariate(5, 1.2))))) for i in range(400)] + [(500 + i, t) for i, t in enumerate(ODD)] + [(7, "again and again"), (7, "again and again")]
    rows.append((900, " ".join(rng.choice(words) for _ in range(30_000))))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, tier int").repartition(parts)
    out = P.pack(docs, PATH, round_tokens=1 << 15).collect()
    used, padding, sequences = check(out, rows)
    assert len({k >> 40 for k in sequences}) == parts and padding <= parts * 4096
    groups = defaultdict(int)
    for s in sequences.values():
        groups[s[0]["step_group"]] += s[0]["tier"]
    assert max(groups.values()) <= P.GROUP_TOKENS


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "x y")], "doc_id long, text string")
    assert P.pack(docs.limit(0), PATH).count() == 0
    assert [r["doc_id"] for r in P.pack(docs, PATH).collect()] == [None]
    assert zlib.crc32(bytes(P.pack(docs, PATH).first()["token_ids"])) > 0
    with pytest.raises(ValueError):
        P.pack(docs, PATH, tiers=(1000,))


def test_very_long_documents_are_cut_in_place():
    packer = P.Packer(P.TIERS)
    full = packer.take(P.Doc("a", bytes(4 * (3_000_000 * 4096 // 4096 + 5)), 0, 3_000_005))
    assert len(full) == 3_000_005 // 4096 and all(len(w[0]) == 4096 and len(w[0].ids) == 4 * 4096 for w in full[:3])
    assert full[0][0].whole is full[-1][0].whole and packer.held == 3_000_005 % 4096
