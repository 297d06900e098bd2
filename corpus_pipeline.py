"""Corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, benchmark
decontamination, best-fit packing, each over all that the stage before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; the caller writes its result
as Parquet and hands it to the next as docs.  All but the last return the columns of
documents.

Rows are told apart by id and text, so NULL and repeated ids are decided one by one: a
stage drops the row it means and no other of that id.  Rows that repeat both id and text
cannot be told apart and share every decision.  NULL texts count as empty: the classifier
scores them by its offset alone, the exact stage keeps one of them, they join the group of
fingerprint zero, contain no benchmark item and are packed as the end token.  Texts are
taken whole, whatever their length; columns of other names are carried along.  Empty tables
give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfpulse.llm import decontam, exact_dedup, packing, quality, simhash
from shelfpulse.llm.common import read, saved, text_key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more; the model learns from all labelled rows' bounded sample."""
    weights = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, weights, keep=tuple(docs.columns), named=("__score", "__good"))
    return scored.filter("__good = 1").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id.  Rows are told apart by id and text."""
    keep = (exact_dedup.exact_groups(docs).filter("kept")
            .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct())
    sha = F.sha2(exact_dedup.lowered().cast("binary"), 256)
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (sha == F.col("__sha")), "left_semi")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id (of equal ids the
    one with the smallest text hash; a row without id only where no row of the group has one)."""
    text = text_key()
    groups = (simhash.simhash_groups(docs.select(text.alias("doc_id"), "text"), shingle=4, max_bits=4)
              .select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct())
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    keep = (docs.select(F.col("doc_id").alias("id"), text.alias("key")).join(groups, "key")
            .groupBy("group").agg(F.min(row).alias("first"))
            .select(F.col("first.id").alias("__id"), F.col("first.key").alias("__text_key")))
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (text == F.col("__text_key")), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains no benchmark item."""
    return decontam.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None       # the classifier, the near-duplicate groups and the ids are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
