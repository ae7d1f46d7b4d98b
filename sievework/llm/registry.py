"""The registered queries ``opN_<name>`` of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import bpe, decontam, html_crf, langid, near_dups, pseudonyms, quality_qda, rans, suffix_dedup, weak_supervision
from sievework.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "pseudonym_key", "vocabulary"]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The session's ``spark.sievework.pseudonymKey``; the public demonstration key if it is unset."""
    return spark.conf.get("spark.sievework.pseudonymKey", None) or "demonstration-key-not-secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hit_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.score_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_table(_table(spark, sf_dir, "documents"))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_supervision.verdicts(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_table(_table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(_table(spark, sf_dir, "pages"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.components(_table(spark, sf_dir, "documents"), size=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_rans": op3_rans,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_weak_supervision": op5_weak_supervision,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_main_text": op9_main_text,
    "op10_near_dups": op10_near_dups,
}
