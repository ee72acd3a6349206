"""A corpus from raw documents to packed sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerolens.llm.common import drop_written, table, written
from aerolens.llm.jaccard import keep_one
from aerolens.llm.language import fit, keep_identified
from aerolens.llm.mixing import label_weights, mix_documents
from aerolens.llm.packing import pack_documents
from aerolens.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those whose language is too close to call go."""
    return keep_identified(docs, fit(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.75 or more on five-word shingles hold together, one document of the smallest doc_id stays; null counts as the largest."""
    return keep_one(docs, nameless=True)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each run of secrets in it is replaced by a mark."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix of sources takes it: up to two times, or not at all."""
    return mix_documents(docs, label_weights(table(spark, sf_dir, "labels")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place."""
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("secret_scan", secret_scan), ("source_mix", source_mix), ("best_fit_packing", packing)]

#: Neither compression nor byte-pair encoding can be expressed in SQL; tests/llm hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each but the last is written to the shared folder, read again and then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
