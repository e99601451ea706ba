"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)``, with ``docs`` what the stage before has kept, and returns a DataFrame. All but the
last return the columns of ``docs``; the last returns the encoded documents. ``run`` writes each stage's rows as Parquet below
the shared folder and reads them again for the next, so a lost executor costs one stage's tasks at most.

Rows that repeat a document's id stay or go together. A stage leaves columns it does not know as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from dosewise.llm.common import free_name, prepare, table
from dosewise.session import workspace


def _keep(docs: DataFrame, verdict: DataFrame, keep: str) -> DataFrame:
    """The rows of ``docs`` whose id has ``keep`` true in ``verdict``; ids are compared with null equal to null."""
    key = free_name(docs.columns, "kept_id")
    kept = verdict.where(keep).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(kept[key]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rules reject. The line model is trained on labelled rows of this stage's input."""
    prepare(spark)
    crf = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return _keep(docs, quality_rules.judge(docs, crf).select("doc_id", "kept"), "kept")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows; ``n_chars`` follows the text. Emptied documents go."""
    prepare(spark)
    cleaned = line_dedup.dedup(docs)
    removed = cleaned.columns[-1]
    left = cleaned.where((F.col(removed) == 0) | (F.length(F.trim(F.col("text"))) > 0))
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return left.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each component of near duplicates the document of lowest id."""
    prepare(spark)
    found = ngram_join.join(docs)
    return _keep(docs, found.select("doc_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")), "kept")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by benchmark items."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return _keep(docs, found.select("doc_id", (~F.col("contaminated")).alias("kept")), "kept")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document: ids as packed little-endian unsigned 32-bit integers, and the
    digest of the text that they give when decoded."""
    prepare(spark)
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", encode),
]

#: Training of the line model and the token merges are not expressible in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = workspace(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
