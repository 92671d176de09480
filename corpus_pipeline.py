"""Corpus pipeline: quality rules, line dedup, near-copies, source mix and token ids, each stage on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import small_batches, written
from brindle.llm.line_dedup import dedup_lines
from brindle.llm.mixing import mix_sources
from brindle.llm.quality import fit_quality, rate_documents
from brindle.llm.simhash import drop_near_copies
from brindle.llm.tokens import decode, encode


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the trees fitted on the labels; the columns unchanged."""
    small_batches(spark)
    trees = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = rate_documents(docs.select(F.struct("*").alias("_row"), "text"), trees)
    return rated.where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an older document holds; n_chars follows the text. A document may lose all lines."""
    small_batches(spark)
    out = dedup_lines(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"_row.{c}") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies."""
    small_batches(spark)
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none to three times."""
    return mix_sources(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids, n_tokens and round_trip: whether decoding the ids gives the text again."""
    small_batches(spark)
    out = decode(encode(docs.select(F.struct("*").alias("_row"), "text")))
    new = {"ids": F.col("ids"), "n_tokens": F.col("n_tokens"), "round_trip": F.col("decoded") == F.coalesce("text", F.lit(""))}
    return out.select(*[F.col(f"_row.{c}") for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_copies),
    ("source_mix", source_mix),
    ("sentencepiece", token_ids),
]

#: Boosted trees and XXH64 are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
