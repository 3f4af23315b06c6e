"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``).

Results read them when they are used, so an operator cannot delete its own;
whoever has used the result may.  Operators take a ``folder`` for that.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder of the shared one; a local session without that setting gets it in the temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/inkmesh-scratch-{os.getuid()}"
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a Parquet table of the folder: what follows does not depend on the plan that made it."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
