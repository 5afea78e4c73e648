"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes all rows that the one before it kept.  Between stages the
rows are written as Parquet and read again, which also cuts lineage.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import line_dedup, mixing, ngram_join, sentencepiece, toxicity
from lorebase.llm.common import WORD, Scratch, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this much of their five-word shingles; op6's own values are for op6 alone.
NEAR_WORDS, NEAR_SHARE = 5, Fraction(80, 100)


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the labels that op9 learns from.

    Null and empty texts are scored as texts without words, and stay.  Repeated
    rows are scored alike and all stay or all go.  Without labels of both kinds
    the score is the share of toxic labels.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), toxicity.not_held_out())
    kept = toxicity.score(docs.select(COLUMNS), model, tuple(COLUMNS[1:])).where(F.col("score") < toxicity.THRESHOLD)
    return kept.select(COLUMNS)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites carry.

    Null text stays null and empty text empty; a null source is no site; a
    document of which nothing would be left, and a copy of a page, stay whole.
    Repeated rows all stay.
    """
    rows = line_dedup.remove_spread_lines(docs.select(COLUMNS))
    return _documents(rows.withColumn("text", F.col("kept_text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents: the least doc_id, null last, then the least text hash.

    Rows are told apart by doc_id and text, so repeated or null doc_ids hide no
    copy; texts without words have no copies and stay.
    """
    docs = docs.select(COLUMNS)
    found = ngram_join.jaccard_components(docs, shingle=NEAR_WORDS, threshold=NEAR_SHARE).where("n_shingles > 0")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_h"))
    wordy = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.where(wordy).withColumn("_hash", F.xxhash64("text"))
    rows = rows.join(first, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_hash"] == F.col("_h")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_hash"]).select(COLUMNS).unionByName(docs.where(~wordy))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents once for each round that takes of them.

    Rows without words take no part in a mix of words; a null source is a
    source of its own, last in order.  Rows equal in doc_id, source and text are
    one stretch of the line each, and interchangeable.
    """
    return _documents(mixing.mixed_documents(docs.select(COLUMNS)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of every document.

    Null text has null ids and a null n_tokens, empty text none; repeated rows each get a result.
    """
    rows = sentencepiece.encode(docs.select(COLUMNS), sentencepiece.read_model())
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_spread_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", tokenize),
]

#: The toxicity model and the token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
