"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm import toxicity
from inkmesh.llm.common import materialize, read_table, remove, shared_dir, unused
from inkmesh.llm.decontaminate import decontaminate
from inkmesh.llm.lsh_forest import jaccard_join, one_per_class
from inkmesh.llm.packing import pack
from inkmesh.llm.queries import public_tokenizer
from inkmesh.llm.secret_scan import redacted, scan_secrets

def _result(docs: DataFrame) -> str:
    """A name for the struct column that a stage adds and drops again, new to its input."""
    return unused(docs, "__stage_result")


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), train_where=~toxicity.held_out())
    result = _result(docs)
    scored = toxicity.score_toxicity(docs, model, into=result)
    return _columns(scored.where(F.col(result)["predicted"] != 1), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    members, _ = jaccard_join(docs)
    return one_per_class(docs, members)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of a benchmark item."""
    result = _result(docs)
    marked = decontaminate(docs, read_table(spark, sf_dir, "benchmark"), into=result)
    return _columns(marked.where(~F.col(result)["contaminated"]), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by ``[secret]`` and n_chars to match."""
    result = _result(docs)
    marked = scan_secrets(docs, into=result)
    spans, clean = F.col(result)["spans"], unused(docs, "__clean_text")
    out = marked.withColumn(clean, redacted(F.col("text"), spans))
    new = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(spans) > 0, F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return pack(docs, public_tokenizer()).withColumn("ids_crc32", F.crc32("token_ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: The tokenizer, the boosted trees and the randomness battery are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    folder, before = shared_dir(spark), None
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), folder, name)
        if before:  # read no more
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
