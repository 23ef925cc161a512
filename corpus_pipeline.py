"""A training-data pipeline over ``documents``: identify, dedup lines, dedup documents, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and reads it back as the next stage's documents. All stages but the last keep the
columns of documents, whatever their names; n_chars follows the text.

Null texts and texts without a letter go in the first stage. Repeated rows with one doc_id count as one document for
lines and near-duplicates (all of them stay or go), and stand at one place of the mix. Of ties, the smallest doc_id
stays. Texts of any length are worked on whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconcilia.llm import hd_langid, hyperminhash, line_dedup, mixing, unigram_pieces
from reconcilia.llm.common import arrow_rows, saved, table, without
from reconcilia.storage import scratch, written


#: Texts that go to a Python worker at a time, in any stage.
BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Workers stay while the session lives, so what they and the executors hold for a batch of texts adds up over the stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or like no language at all, go."""
    small_batches(spark)
    model = hd_langid.learn(docs.where(hd_langid.fold(F.col("doc_id")) != 1))
    return hd_langid.recognised(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without duplicate lines; a document that loses all of its lines goes."""
    return line_dedup.lines_left(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    found = hyperminhash.near_duplicates(docs, words=5, share=80)
    return without(docs, "doc_id", saved(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights by whole and fractional repetitions."""
    return mixing.repeated(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with proof of the round trip."""
    small_batches(spark)
    return unigram_pieces.encoded(docs, columns=["doc_id", "lang", "source", "n_chars"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Language ID and piece encoding can't be said in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with arrow_rows(spark, BATCH):  # stages set it for what they leave to be run later; here it is put back
        for _, stage in STAGES:
            with scratch(spark) as made:  # what a stage wrote on its way goes when its result is written
                out = written(stage(spark, docs, sf_dir))
                made.remove(out)
            docs = spark.read.parquet(out)
    return docs
