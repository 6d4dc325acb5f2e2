"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_tree, ctw, decontaminate, langid, license_scan, nbsvm, packing, phrases, pii, quality_rules, simhash, sstable, whitening
from .common import documents, table
from .encoding import vocabulary_path
from .oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op2_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.digest(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(documents(spark, sf_dir))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op6_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digest(documents(spark, sf_dir), vocabulary_path())


def op7_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir))


def op10_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(documents(spark, sf_dir), vocabulary_path())


def op11_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.digest(chat_tree.with_probe(spark, table(spark, sf_dir, "conversations")))


def op12_gramian_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_simhash_pivots": op1_simhash_pivots,
    "op2_nb_svm_quality": op2_nb_svm_quality,
    "op3_centroid_language": op3_centroid_language,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_license_sentences": op5_license_sentences,
    "op6_sorted_string_tables": op6_sorted_string_tables,
    "op7_semi_markov_pii": op7_semi_markov_pii,
    "op8_line_quality": op8_line_quality,
    "op9_context_tree": op9_context_tree,
    "op10_dominance_packing": op10_dominance_packing,
    "op11_chat_prefix_tree": op11_chat_prefix_tree,
    "op12_gramian_whitening": op12_gramian_whitening,
    "op13_suffix_phrases": op13_suffix_phrases,
}
