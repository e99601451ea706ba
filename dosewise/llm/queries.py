"""The registered queries of the corpus operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workspace
from . import bpe, chat, collocations, compact_windows, decontaminate, divergence, line_dedup, ngram_join, pairwise_quality, quality_rules, secrets, url_filter, wavelet
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def parts(spark: SparkSession) -> int:
    """Tasks for a shuffle of whole texts: what the session asks for, and some per core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


@query
def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark)
    wavelet.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 2, parts(spark))
    return wavelet.digests(spark, folder)


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    records = rows.unionByName(added).select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    folder = workspace(spark)
    chat.format_records(records, parts(spark)).write.parquet(folder)
    return chat.digests(spark.read.parquet(folder), parts(spark))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "lang", "source", "n_lines", "n_removed", "text")


ORACLES["op6_line_dedup"] = line_dedup.ORACLE


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, crf)


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query
def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "finding", F.round("probability", 6).alias("probability"), "is_secret")


@query
def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.find(table(spark, sf_dir, "documents"))


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is that of the table's own pages whose host holds one of the listed words."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, pages.where(url_filter.listed_host(F.col("url"))), url_filter.RULES)


ORACLES["op13_url_filter"] = url_filter.ORACLE


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = divergence.ORACLE


@query
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_mining"] = collocations.ORACLE
