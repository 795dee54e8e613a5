"""The stages of corpus_pipeline.py, each a thin use of one operator.

Every stage takes any rows with doc_id and text: null and empty texts, repeated rows and further columns are allowed, and an
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import exact_dedup, language, packing, secret_scan, simhash
from .common import fold

#: A text goes if its language is unknown (no letter) or less probable than this.
LEAST_CONFIDENCE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known with confidence; texts that are null or have no letter go."""
    configure(spark)
    model = language.fit(docs.where(fold("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang"))
    return language.confident(docs, model, LEAST_CONFIDENCE)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest doc_id. Columns that have a name of the
    operator's result keep their values."""
    aside = {c: f"__given_{c}" for c in docs.columns if c in exact_dedup.RESULT}
    kept = exact_dedup.mark_copies(docs.withColumnsRenamed(aside)).where("kept")
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays; of repeated rows one."""
    configure(spark)
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in the text replaced and n_chars counted anew; clean texts are untouched."""
    configure(spark)
    clean = secret_scan.masked(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along the Hilbert curve: one row for each piece of a document."""
    configure(spark)
    found = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")
