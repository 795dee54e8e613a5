"""A cleaning run over `documents`: each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.llm import pipeline_stages as stages
from ticketloom.llm.common import table, written

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", stages.known_language),
    ("exact_dedup", stages.first_copies),
    ("simhash_near_dedup", stages.one_of_each_group),
    ("secret_scans", stages.without_secrets),
    ("packing", stages.packed),
]

#: Language ID is a trained model, so SQL cannot give the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
