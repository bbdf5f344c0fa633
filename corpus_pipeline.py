"""Corpus pipeline: quality rules, language ID, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns all columns of documents, but for the
last, which returns the packed pieces. Columns beside those of documents are kept too, whatever their names. Quality rules
and language ID decide where a row lies; only near-duplicate removal moves texts, once.

Rows that share a doc_id are judged by their own text; of rows that repeat doc_id and text one stays after near-duplicate
removal. Rows without a doc_id are linked, and kept, like others. Null and blank texts fail the quality rules; should a
later stage get them, language ID drops them (no letter), near-duplicate removal keeps them (linked with nothing), packing
gives their end id. An empty table gives an empty result. Very long texts are read whole by every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import langid, neardup, packing, quality
from glossweave.llm.common import fresh, scratch_table, table

LEAST_SCORE = 0.35


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those without a letter and those whose best language is under LEAST_SCORE."""
    found, (lang, score) = langid.identify(docs, docs.filter(~langid.held_out())), langid.own_names(docs)
    return found.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8) the document with the smallest doc_id stays, once; one without a
    doc_id only where no other is.

    A row is known by a 64-bit hash of doc_id and text. Verdicts are made of hashes and ids; the texts meet them once.
    """
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull()))
    found = neardup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), 80).select(F.col("doc_id").alias(key), "component_id")
    ids = keyed.select(key, F.col("doc_id").cast("long").alias("_id"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col(key))
    # partial results of each task come before the shuffle, so copies are one row a task
    least = ids.groupBy(key).agg(F.min("_id").alias("_id")).join(found.groupBy(key).agg(F.min("component_id").alias("component_id")), key)
    kept = scratch_table(least.groupBy("component_id").agg(F.min(order).alias("_first")).select(F.col(f"_first.{key}").alias(key)), "kept", rows=docs.count())
    single = keyed.dropDuplicates([key])
    # the same join at every size
    return single.join(kept.hint("merge"), key, "left_semi").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_stage), ("language_id", language_stage), ("near_dedup", dedup_stage), ("packing", packing_stage)]

#: Language ID, MinHash and tokenizers have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch_table(docs, name)
    return docs
