import base64
import hashlib
import io
import struct

import pytest
import zstandard

from inkmesh.llm import warc_zst as W
from inkmesh.llm.common import shared_dir


def pages():
    rows = [(i, f"http://x/{i}", f"<html><body>page number {i} of the site, with words</body></html>" * (1 + i % 5)) for i in range(60)]
    same = "<html>the same page</html>" * 20
    rows += [(100 + i, "http://same", same) for i in range(40)]
    rows += [(200, None, None), (201, "http://e", ""), (202, "http://e\r\nX: y", None), (203, "u", "\U0001f600" * 70_000), (204, "u", "t"), (204, "u", "t"), (205, "v", "t"), (205, "v", "t"), (None, "n", "t"), (None, "n", "alone")]
    return rows


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        peers = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        owner = max(peers, default=None)
        response = len(payload) < least or owner is None or page == owner
        out.append((str(page) if page is not None else "", len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if response else "revisit", None if response else str(owner)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,size,sent", [(0, 1 << 20, 250_000), (30, 3000, 0)])
def test_round_trip(spark, monkeypatch, least, size, sent):
    monkeypatch.setattr(W, "MAX_BROADCAST_DIGESTS", sent)
    rows = pages()
    table = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows], "page_id long, url string, html string, digest int, owner string").repartition(3)
    folder = shared_dir(spark)
    manifest = W.write_archives(table, folder, min_revisit_bytes=least, archive_bytes=size)
    got = W.read_archives(manifest, folder).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == expected(rows, least)
    for r in got:
        assert len(r["payload"]) == (r["payload_bytes"] if r["record_type"] == "response" else 0)
    assert sum(m["records"] for m in manifest.collect()) == len(rows)


def test_archive_layout():
    records = [W.record_bytes(str(i), f"http://x/{i}", f"<p>hello number {i} hello hello</p>".encode() * 9, W.base32_sha1(f"<p>hello number {i} hello hello</p>".encode() * 9), None) for i in range(400)]
    raw, places = W.archive_bytes_of(records)
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == W.DICTIONARY_MAGIC and places[0][0] == 8 + n
    d = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
    assert d.dict_id() != 0
    for (at, size), record in zip(places, records, strict=True):  # each record stands alone
        assert zstandard.ZstdDecompressor(dict_data=d).decompress(raw[at : at + size], max_output_size=1 << 20) == record
    assert list(W.read_archive(io.BytesIO(raw))) == records
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(raw) - 8 - n < plain / 2


def test_few_records_have_no_dictionary():
    raw, _ = W.archive_bytes_of([b"WARC/1.1\r\n\r\n"])
    assert raw[:4] != struct.pack("<I", W.DICTIONARY_MAGIC) and list(W.read_archive(io.BytesIO(raw))) == [b"WARC/1.1\r\n\r\n"]


def test_damage_is_noticed():
    record = W.record_bytes("1", "u", b"abc", W.base32_sha1(b"abd"), None)
    with pytest.raises(ValueError):
        W.parse_record(record)


def test_empty_table(spark):
    folder = shared_dir(spark)
    manifest = W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.count() == 0 and W.read_archives(manifest, folder).count() == 0


def test_base32_of_hex(spark):
    from pyspark.sql import functions as F

    digest = hashlib.sha1(b"x").hexdigest()
    assert spark.range(1).select(W.base32_of_hex(F.lit(digest))).first()[0] == W.base32_sha1(b"x")
