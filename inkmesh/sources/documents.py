"""Opaque documents to text, and the log sink.

The extractor is injected: a function from a document's bytes to the texts of
its pages.  Any failure gives a null text, not a failed job.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("inkmesh")


def plain_pages(content: bytes) -> list[str]:
    """Extractor for plain text: pages end with a form feed."""
    return content.decode("utf-8").split("\f")


def read_documents(spark: SparkSession, path: str, extractor: Callable[[bytes], list[str]] = plain_pages, glob: str | None = None) -> DataFrame:
    """(path, text): pages in order, joined without a separator; text is null where extraction fails."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return extract(reader.load(path).select("path", "content"), extractor)


def extract(files: DataFrame, extractor: Callable[[bytes], list[str]] = plain_pages) -> DataFrame:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            out = []
            for c in contents:
                try:
                    out.append("".join(extractor(c.as_py())))
                except Exception:  # noqa: BLE001  whatever a document does to its extractor
                    log.warning("a document could not be read", exc_info=True)
                    out.append(None)
            yield pa.array(out, pa.string())

    return files.select("path", run("content").alias("text"))


def join_pages(pages: DataFrame) -> DataFrame:
    """(path, page, text) to (path, text), in order of page, without a separator."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("path").agg(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"))


def append_log(messages: DataFrame, path: str, ts: str = "ts", message: str = "message") -> None:
    """``[timestamp] message`` lines, appended as text files."""
    messages.select(F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("] "), F.col(message))).write.mode("append").text(path)
