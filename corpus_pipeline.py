"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catweave.llm import neardup, packing, substring, toxicity
from catweave.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects (score of one half or more).

    Null and empty texts are scored as empty ones; repeated rows and rows with a null id are judged by their
    texts like all others; a table without rows stays empty; columns stay as they are, whatever their names.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, model, SCORE).where(F.col(SCORE) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id.

    Null and empty texts are copies of each other; of rows that repeat an id and a text one stays; rows
    with a null id all stay; a table without rows stays empty; columns stay as they are.
    """
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words that start in an earlier one too.

    Null texts stay null and short ones whole; rows of one id don't count against each other, a null id is
    later than all others; a table without rows stays empty; columns stay as they are, but that
    ``n_chars``, where there is one, becomes the length of a text that lost words.
    """
    cut = substring.remove_repeats(docs, length=50, names=(WORDS, GONE))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(GONE) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    A null or empty text is a document of the end id alone; repeated rows and rows with a null id are
    packed each; a table without rows gives none; only ``doc_id`` and ``text`` are read.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


#: Columns that stages add and drop again.
SCORE, WORDS, GONE = "_catweave_score", "_catweave_words", "_catweave_gone"
STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("packing", pack_sequences)]

#: Learned scores and alignment are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.  What a stage gives is stored before the next one reads it, so no stage
    runs twice and a lost executor costs none that is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
