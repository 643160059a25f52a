"""The operators applied to their whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, count, html_text, neardup, packing, substring, tiff, tokenfile, toxicity
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_token_files(tokenfile.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), length=50, digest=True)


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_round_trip(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_html_extraction, op2_near_dedup, op3_token_files, op4_bpe, op5_substring_dedup,
        op6_tiff, op7_toxicity, op8_nearest_neighbours, op9_packing, op10_token_counts,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """None: tokenizers, parsers, models and file formats are beyond SQL, and the window sequences of whole
    tables are too many for it.  ``tests/llm`` holds each query against a plain version."""
    return {}
