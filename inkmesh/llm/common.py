"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Only a local session (one machine, as in tests) may lack that setting: it
    then gets a temporary folder, and the setting for the rest of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "inkmesh-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/inkmesh-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is read no more, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished jobs now: it does so for plans that the driver's collector finds unused."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes that are sent to a Python worker at once, and that it takes up at once.
BATCH_BYTES = 1 << 22


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most (and one row at least), from here on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_KEPT: dict[tuple, object] = {}


def kept(kind: str, key, make: Callable):
    """What ``make`` builds, once for (kind, key) in each Python worker.

    A worker keeps one such object only: it is used again by other operators,
    which must not pile up what they remember.
    """
    if (kind, key) not in _KEPT:
        _KEPT.clear()
        _KEPT[kind, key] = make()
    return _KEPT[kind, key]


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new to ``df``."""
    known = {c.lower() for c in df.columns}
    while name in known:
        name = f"_{name}"
    return name


def small_batches(batches: Iterator) -> Iterator[pa.Array]:
    """Arrow arrays of texts (or tuples of arrays led by one), each cut to about ``BATCH_BYTES``, with one result for each.

    To be used where a result array may be as short as its part: in a scalar
    iterator UDF Spark asks only that the results line up with the rows.
    """
    for batch in batches:
        lead = batch[0] if isinstance(batch, tuple) else batch
        rows = max(1, min(len(lead), len(lead) * BATCH_BYTES // max(1, lead.nbytes)))
        for low in range(0, max(1, len(lead)), rows):
            yield tuple(x.slice(low, rows) for x in batch) if isinstance(batch, tuple) else batch.slice(low, rows)


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a reread, not a recompute.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, into: str, value: Column) -> DataFrame:
    """``df`` with the struct column ``into``; a column of that name is replaced."""
    bound_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != into.lower()], value.alias(into))


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(modulus))
