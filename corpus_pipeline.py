"""From raw documents to token ids: five stages, each a written table that the next one reads.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of the documents. A stage that is lost with its executors is done again from the table before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promoforge.llm.common import table
from promoforge.llm.line_patience import delete_common
from promoforge.llm.near_copies import first_copies
from promoforge.llm.quality_outliers import keep_good
from promoforge.llm.unigram_pieces import encode_texts
from promoforge.llm.winnowing import drop_contaminated
from promoforge.session import written_once


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the base limits and are no outliers of their language and source."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier text has are deleted; texts left without words go."""
    return delete_common(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: fingerprints compared by bit planes, five-word shingles for the rest, similarity 0.8 and more."""
    return first_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding."""
    return encode_texts(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pieces", pieces)]

# Alignment, outliers and Viterbi are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written_once(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
