"""Readers with explicit schemas, so no data is scanned to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import embedding_text
from ..operators.knowledge import file_texts, within_limit
from ..schema import CORRECTIONS, EMPTY_LABEL_ROWS, EVAL_CSV, KB_SEED_JSON


def eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows (text, category, urgency); a file may lack label columns."""
    header = spark.read.option("header", True).csv(path).columns  # first line only
    fields = {f.split()[0]: f.strip() for f in EVAL_CSV.split(",")}
    schema = ", ".join(fields.get(c.strip(), f"`{c}` string") for c in header)
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])


def kb_seed(spark: SparkSession, path: str, limit: int = 256) -> tuple[DataFrame, DataFrame]:
    """Knowledge-base entries of a JSON file: those the embedding model reads whole, and the rest."""
    entries = spark.read.schema(KB_SEED_JSON).option("multiLine", True).json(path)
    checked = within_limit(entries, embedding_text("title", "content"), limit)
    return checked.filter("fits").drop("fits", "tokens"), checked.filter("NOT fits").select("title", "tokens")


def help_files(spark: SparkSession, path: str) -> DataFrame:
    """Help documents below a folder as (path, title, text, error)."""
    return file_texts(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """The corrections export; an empty typed frame when nothing has been exported yet."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], CORRECTIONS)
    return spark.read.schema(CORRECTIONS).parquet(path)


def no_label_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EMPTY_LABEL_ROWS)
