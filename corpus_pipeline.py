"""A training-data pipeline over ``documents``: five stages, each over all that the one before it kept.

quality      documents that the quadratic discriminant rejects go
near_dups    one document of each group of near copies stays (five-word shingles, similarity 0.8)
decontaminate benchmark passages are cut out; documents that are mostly such passages go
pseudonyms   personal values are replaced by format-preserving pseudonyms
encode       texts become token ids, with the decoded text beside them

All stages but the last return the columns of documents. Null and empty texts pass through every stage that
doesn't reject them by score; stages are total on empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, decontam, near_dups, pseudonyms, quality_qda
from sievework.llm.common import store
from sievework.llm.registry import pseudonym_key, vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_qda.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs, size=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_spans(docs, _table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(docs, pseudonym_key(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encoded(docs, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dups", near_duplicates),
    ("decontaminate", decontaminate),
    ("pseudonyms", pseudonymise),
    ("encode", encode),
]

#: No SQL expresses the fitted classifier, the trees of the join or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
