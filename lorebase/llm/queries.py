"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, line_dedup, merkle, mixing, ngram_join, prefix_trie, quality_gam, quality_rules, sentencepiece, suffix_dedup, toxicity, url_filter
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents")).drop("source")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.op2_report(read(spark, sf_dir, "documents"), sentencepiece.read_model())


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.op3_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_copies(read(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents")).drop("component", "text_hash")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op7_report(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op8_report(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op11_report(read(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op12_report(read(spark, sf_dir, "documents"), bpe.read_model())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op13_report(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sentencepiece, op3_quality_gam, op4_embed_dedup, op5_url_filter, op6_ngram_join, op7_suffix_dedup, op8_line_dedup, op9_toxicity, op10_quality_rules, op11_merkle, op12_bpe, op13_prefix_trie)}
SQL = {
    "op1_mixing": mixing.ORACLE,
    "op4_embed_dedup": embed_dedup.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op7_suffix_dedup": suffix_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
