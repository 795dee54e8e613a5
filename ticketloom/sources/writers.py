"""Sinks. Spark commits a write job as a whole; these add the guards around it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.feedback import manifest


class AlreadyExists(Exception):
    """Refusing to write onto data that later steps may already refer to."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def guarded(df: DataFrame, path: str, reset: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Write once; existing data is refused unless `reset`. With partitions, a reset replaces only
    the partitions present in `df` (one tenant's rows, for example)."""
    if exists(df.sparkSession, path) and not reset:
        raise AlreadyExists(f"{path} already holds data")
    writer = df.write.mode("overwrite" if reset else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def dataset(df: DataFrame, path: str, reset: bool = False) -> None:
    """Training corpus, one folder per split."""
    guarded(df.select("text", "category", "source", F.col("grp").alias("group"), "split"), path, reset, ("split",))


def corrections(export: DataFrame, path: str) -> None:
    """Replace the export in one step and put a manifest next to it.

    Both are written to a staging name first. A reader sees the old export until the rename; the
    folder replaced is kept under its own name, so a failure in between loses nothing.
    """
    spark = export.sparkSession
    stage = f"{path}.{uuid.uuid4().hex}"
    export.write.parquet(stage)
    written = spark.read.schema(export.schema).parquet(stage)
    manifest(written).withColumn("exported_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}.manifest")
    fs, target = _fs(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(target):
        fs.rename(target, path_of(f"{stage}.old"))
    if not fs.rename(path_of(stage), target):
        raise OSError(f"could not publish {stage} as {path}")


def replace_sections(sections: DataFrame, path: str) -> None:
    """Write reprocessed sections, replacing the documents' partitions as a whole.

    Sections are laid out by tenant and a hash bucket of the document; only buckets present in
    `sections` are rewritten, so the frame must hold every document of its buckets.
    """
    bucketed = sections.withColumn("doc_bucket", F.pmod(F.xxhash64("document_id"), F.lit(256)).cast("int"))
    (
        bucketed.repartition("tenant_id", "doc_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("tenant_id", "doc_bucket")
        .parquet(path)
    )
