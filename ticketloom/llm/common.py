"""Helpers shared by the text operators: reading, folds, writing through the shared folder, bounded fits."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, shared_dir

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(rf"[^{SPACES}]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (the path may be in any store)."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo `parts`; null ids count as empty text."""
    key = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, computed once and read back from the folder that all executors share."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without_spaces(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
        group = np.cumsum(sizes, dtype=np.int64) // limit
        start = 0
        for end in [*(np.flatnonzero(np.diff(group)) + 1), len(sizes)]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs started inside; the former values come back."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def crc(values: np.ndarray) -> int:
    return zlib.crc32(values.astype("<u4").tobytes())
