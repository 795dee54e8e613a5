"""Running a stream to the end of its input and keeping what it wrote exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A driver table as a stream of files; the schema is fixed up front.

    The path is a pattern that only the table matches: a stream takes no plain path of a single file, and the pattern reads a
    table that is one file and one that is a folder of part files alike.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def batch_writer(path: str, before: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to its own folder. A repeated batch replaces itself, so a restart after
    a failure in the middle neither loses nor doubles rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if before is not None:
            before(batch_id)

    return write


def start(stream: DataFrame, path: str, checkpoint: str, mode: str, hook=None) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(batch_writer(path, hook))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def written(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Everything the batches wrote, with the batch number."""
    schema = T.StructType([*like.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Process all available input and read the results back from the shared folder; `base` holds `out` and `checkpoint`."""
    spark = stream.sparkSession
    base = base or shared_dir(spark, "stream")
    query = start(stream, f"{base}/out", f"{base}/checkpoint", mode)
    query.awaitTermination()
    return written(spark, f"{base}/out", stream)


def latest_per_key(updates: DataFrame, keys: list[str], version: str = "batch_id") -> DataFrame:
    """State after update-mode batches: the newest version of each key."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id", version)]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), version).alias("v"))
        .select(*keys, *[F.col("v")[c].alias(c) for c in values])
    )
