"""Dictionary-compressed WARC archives: writer and reader.

Each archive is a ``.warc.zst`` file: first a skippable frame (magic
0x184D2A5D) that holds a Zstandard dictionary built from the archive's own
records, then one independent Zstandard frame per WARC record, compressed with
that dictionary.  A task gathers records up to ``archive_bytes``, builds the
dictionary from records spread evenly over all of them, compresses and writes
the archive, and goes on with the next; so memory is bounded by one archive.

Records with equal payloads are written once: the one with the largest page id
is a ``response``, the others are ``revisit`` records that refer to it.

Archives are written with pyarrow's file systems under the shared folder.  An
archive's name has a random part, and only the archives that a finished task
reports are in the manifest, so a task that is run again leaves no doubt.

Defined cases: a null payload is empty; repeated rows (same page id, same
payload) that share the largest id are all responses; a null page id never is
the largest if another is known and stands as '' in the record; payloads under
``min_revisit_bytes`` are always responses; with fewer than
``min_dictionary_records`` records no dictionary can be built and the first
frame is left out; an empty table writes no archive and reads back no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmesh.llm.common import bound_batches, materialize

DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of records that a dictionary is built from, taken evenly over the archive.
TRAINING_BYTES = 2 << 20
MIN_DICTIONARY_RECORDS = 16
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated payload digests up to which their list is sent to all tasks.
MAX_BROADCAST_DIGESTS = 250_000
_CRLF = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: str) -> str:
    return f"<urn:x-page:{page_id}>"


def record_bytes(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC 1.1 record; a revisit keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def parse_record(raw: bytes) -> dict:
    """Fields of one record, and its payload; a response's payload is held against its digest."""
    head, _, rest = raw.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(_CRLF * 2)
    size = int(next(x for x in http.split(_CRLF) if x.startswith(b"Content-Length: "))[16:])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if field["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"{field['WARC-Record-ID']}: the payload does not match its digest")
    page = lambda uri: uri[len("<urn:x-page:") : -1]
    refers = field.get("WARC-Refers-To")
    return {
        "page_id": page(field["WARC-Record-ID"]), "url": field["WARC-Target-URI"], "payload": payload, "payload_bytes": size,
        "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": page(refers) if refers else None,
    }


def build_dictionary(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """From records spread evenly over the archive, ``TRAINING_BYTES`` of them."""
    if len(records) < MIN_DICTIONARY_RECORDS:
        return None
    total = sum(map(len, records))
    step = max(1, total // TRAINING_BYTES)
    samples = records[::step]
    try:
        return zstandard.train_dictionary(min(dictionary_bytes, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:  # too little to learn from, such as equal tiny records
        return None


def archive_bytes_of(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """A whole archive and each record's place in it (offset, length)."""
    dictionary = build_dictionary(records)
    parts, places, at = [], [], 0
    if dictionary is not None:
        raw = dictionary.as_bytes()
        parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        at = len(parts[0])
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress
    for r in records:
        frame = compress(r)
        places.append((at, len(frame)))
        parts.append(frame)
        at += len(frame)
    return b"".join(parts), places


def read_archive(stream) -> Iterator[bytes]:
    """Records of one archive, one after the other, reading a bounded part at a time."""
    dictionary, rest = None, stream.read(8)
    if len(rest) == 8 and struct.unpack("<I", rest[:4])[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", rest[4:])[0]))
        rest = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    frame, out = None, []
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                break
        if frame is None:
            frame, out = decompressor.decompressobj(), []
        out.append(frame.decompress(rest))
        rest = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(out)
            frame = None
    if frame is not None:
        raise ValueError("the archive ends within a frame")


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex column, in groups of five bytes."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(digest, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    return F.concat(*[F.substring(F.lit(alphabet), (F.shiftright(v, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for v in groups for k in range(8)])


def plan_records(pages: DataFrame, folder: str, id_column: str, url: str, html: str, min_revisit_bytes: int) -> DataFrame:
    """Rows to write: id, url, payload, digest and ``refers_to`` (null: a response).

    Repeated digests are found by a grouped count of (digest, size, id), so the
    payloads are shuffled only if the list of repeated digests is too long to
    send; then the join is on the digest, whose hot values Spark splits.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_column).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url") if url in pages.columns else F.lit("").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest")
    )
    repeated = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("owner")).where("n > 1").select("digest", "owner")
    repeated = materialize(repeated, folder, "repeated")
    few = repeated.count() <= MAX_BROADCAST_DIGESTS
    joined = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))


_MANIFEST = T.StructType([T.StructField("archive", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType()), T.StructField("raw_bytes", T.LongType())])


def write_archives(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes the archives under ``folder`` (a URI all executors share) and returns their manifest."""
    bound_batches(pages.sparkSession)
    planned = plan_records(pages, folder, id_column, url, html, min_revisit_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        held, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            content, _ = archive_bytes_of(held)
            fs.create_dir(f"{root}/archives", recursive=True)
            path = f"{root}/archives/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(path) as f:
                f.write(content)
            row = pa.RecordBatch.from_pydict({"archive": [path], "bytes": [len(content)], "records": [len(held)], "raw_bytes": [size]})
            held, size = [], 0
            return row

        for batch in batches:
            for r in batch.to_pylist():
                payload = r["payload"] or b""
                text = lambda x: "" if x is None else str(x)
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                held.append(record_bytes(text(r["page_id"]), r["url"], payload, digest, None if r["refers_to"] is None else str(r["refers_to"])))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return materialize(planned.mapInArrow(write, _MANIFEST), folder, "manifest")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the manifest's archives; ids come back as text."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {"payload": T.BinaryType(), "payload_bytes": T.LongType()}
    arrow = {"payload": pa.binary(), "payload_bytes": pa.int64()}
    if not with_payload:
        names.remove("payload")
    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path) as stream:
                    for raw in read_archive(stream):
                        rows.append(parse_record(raw))
                        size += len(raw) if with_payload else 200
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow.get(n, pa.string())) for n in names], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow.get(n, pa.string())) for n in names], names=names)

    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism, 100_000))
    return manifest.select("archive").repartition(tasks).mapInArrow(read, schema)
