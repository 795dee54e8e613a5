"""Approximate retrieval over a saved inverted index with residual codes.

Building clusters a bounded sample of the entries into cells, gives every entry its nearest cell and keeps what is left of the
vector in one signed byte a dimension. The index is a folder: `cells` (the centres), `codes` (tenant, cell, entry, code, sorted
by tenant and cell, so that a scan skips other cells' row groups) and `sizes` (entries of each tenant and cell). Any later
session can read it.

A search lists the codes of a query's `probes` nearest cells only, ranks them on the grid of `retrieval`, and reads the exact
vectors of the best few. `choose_probes` measures, once for an index, how many cells some queries need to find the given share
of their exact hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..functions.vectors import cosine
from ..schema import TOP_K
from ..session import checkpointed
from .retrieval import TIE_DIGITS, best_of, grid, merge, search_topk, unit_rows

SAMPLE = 20_000  # entries that the centres are fitted on, at most (expected number, chosen by hash)
MOST_CELLS = 4096  # so the centres are at most 4096 x dimension numbers, on the driver and in each worker
ROWS = 2048  # queries and codes of one grid cell
RERANK = 4  # exact comparisons for each hit asked for
MEASURED = 50  # queries whose id this divides measure the recall; where they are under LEAST_MEASURED, all do
LEAST_MEASURED = 50


@dataclass
class Index:
    """A saved index: its folder, the centres (cells x dimension, unit length not implied), codes and sizes."""

    folder: str
    centres: np.ndarray
    codes: DataFrame
    sizes: DataFrame


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of unit rows."""
    rows = np.stack(column.to_numpy(zero_copy_only=False)).astype("float64")
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance to each centre, up to the vector's own length."""
    return (centres**2).sum(axis=1)[None, :] - 2 * vectors @ centres.T


def build(entries: DataFrame, folder: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Index:
    """Index every row of `entries` (entry_id, tenant_id, embedding) below `folder`; rows without a vector are left out.

    cells: by default the root of the number of entries, at most `MOST_CELLS`; the centres are fitted on about `sample` rows.
    """
    entries = entries.select("entry_id", "tenant_id", "embedding").where("size(embedding) > 0")
    size = entries.count()
    cells = max(1, min(cells or round(size**0.5), MOST_CELLS, size))
    if size:
        kept = entries if size <= sample else entries.where(F.pmod(F.xxhash64("entry_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(sample / size * 1_000_000)))
        length = F.greatest(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v)), F.lit(1e-300))
        unit = kept.withColumn("__len", length).select(array_to_vector(F.transform("embedding", lambda v: v.cast("double") / F.col("__len"))).alias("features"))
        centres = np.asarray(KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(unit).clusterCenters())
    else:
        centres = np.zeros((1, 1))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(2))
            cell = np.argmin(_distances(vectors, centres), axis=1)
            rest = vectors - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(cell.astype(np.int32)), batch.column(0), pa.array(scale.astype(np.float32)), pa.array([r.tobytes() for r in codes], pa.binary())],
                ["tenant_id", "cell", "entry_id", "scale", "code"],
            )

    kinds = dict(entries.dtypes)
    schema = f"tenant_id {kinds['tenant_id']}, cell int, entry_id {kinds['entry_id']}, scale float, code binary"
    order = ["tenant_id", "cell", "entry_id"]
    spark = entries.sparkSession
    entries.mapInArrow(code, schema).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/codes")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{folder}/cells")
    spark.read.schema(schema).parquet(f"{folder}/codes").groupBy("tenant_id", "cell").agg(F.count("*").alias("n")).write.parquet(f"{folder}/sizes")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Index:
    """A saved index; only the centres are read here."""
    centres = np.array([r.centre for r in spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()])
    return Index(folder, centres, spark.read.parquet(f"{folder}/codes"), spark.read.parquet(f"{folder}/sizes"))


def _with_vector(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "tenant_id", "embedding").where("size(embedding) > 0")


def probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, tenant_id, embedding, cell): each query with its `probes` nearest cells, one a row."""
    centres, kinds = index.centres, dict(queries.dtypes)
    probes = min(probes, len(centres))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ROWS // probes)  # a batch goes out with about ROWS vectors
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            far = _distances(_matrix(batch.column(2)), centres)
            cells = np.argpartition(far, probes - 1, axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(cells.ravel().astype(np.int32))], ["query_id", "tenant_id", "embedding", "cell"])

    schema = f"query_id {kinds['query_id']}, tenant_id {kinds['tenant_id']}, embedding {kinds['embedding']}, cell int"
    return _with_vector(queries).mapInArrow(near, schema)


def search(index: Index, queries: DataFrame, entries: DataFrame, probes: int, k: int = TOP_K, rows: int = ROWS, rerank: int = RERANK) -> DataFrame:
    """The k entries of the query's tenant closest to each query among its `probes` nearest cells: (query_id, entry_id, rank,
    similarity). `probes` of all cells finds the exact hits but for codes that round two vectors alike.

    entries: the rows that were indexed, for the exact similarity of the best `rerank` * k codes. A query without a vector, or
    whose tenant has no entry in these cells, has no hit.
    """
    centres, wanted = index.centres, rerank * k

    def best(asked: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        def vectors() -> np.ndarray:
            codes = np.frombuffer(b"".join(listed["code"]), np.int8).reshape(len(listed), -1)
            return centres[listed["cell"].to_numpy()] + codes * listed["scale"].to_numpy()[:, None]

        return best_of(asked, listed, vectors, wanted)

    cells = probed(index, queries, probes)
    near = grid(cells, index.codes, ["tenant_id", "cell"], best, rows)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_id")
    few = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).select("query_id", "entry_id")
    exact = few.join(_with_vector(queries).select("query_id", F.col("embedding").alias("asked")), "query_id").join(entries.select("entry_id", "embedding"), "entry_id")
    return merge(exact.select("query_id", "entry_id", F.round(cosine(F.col("asked"), F.col("embedding")), TIE_DIGITS).alias("similarity")), k)


def compared(index: Index, queries: DataFrame, probes: int) -> tuple[int, int]:
    """Codes that a search with `probes` compares, and vectors that the exact search compares."""
    listed = probed(index, queries, probes).select("tenant_id", "cell").join(index.sizes, ["tenant_id", "cell"])
    tenants = index.sizes.groupBy("tenant_id").agg(F.sum("n").alias("n"))
    every = _with_vector(queries).join(tenants, "tenant_id")
    return tuple(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (listed, every))


def measured(queries: DataFrame) -> DataFrame:
    """The queries that measure the recall: those with an id divisible by `MEASURED`, or all where these are few."""
    some = _with_vector(queries).where(F.col("query_id") % MEASURED == 0)
    return some if some.limit(LEAST_MEASURED).count() == LEAST_MEASURED else _with_vector(queries)


def choose_probes(index: Index, queries: DataFrame, exact: DataFrame, floor: float = 0.95) -> int:
    """The fewest cells that hold the share `floor` of the `exact` hits (of these queries, by `search_topk`)."""
    centres = index.centres

    @F.pandas_udf("int")
    def place(vector: pd.Series, cell: pd.Series) -> pd.Series:
        far = _distances(unit_rows(vector), centres)
        return pd.Series((far < far[np.arange(len(far)), cell.to_numpy()][:, None]).sum(axis=1).astype("int32") + 1)

    hits = exact.select("query_id", "entry_id").join(index.codes.select("entry_id", "cell"), "entry_id").join(queries.select("query_id", "embedding"), "query_id")
    needed = sorted(tuple(r) for r in hits.groupBy(place("embedding", "cell").alias("probes")).count().collect())  # a row a cell at most
    found, every = 0, sum(n for _, n in needed)
    for probes, n in needed:
        found += n
        if found >= floor * every:
            return probes
    return 1


def search_measured(entries: DataFrame, queries: DataFrame, folder: str, k: int = TOP_K, floor: float = 0.95, rows: int = ROWS) -> tuple[DataFrame, dict]:
    """Build an index, choose its probes by measured recall, and search all queries: the hits, and what was measured.

    The exact search runs for the measuring queries only (`measured`), once: its hits choose the probes and give the recall.
    """
    index = build(entries, folder)
    few = checkpointed(measured(queries), "ann-measured")
    exact = checkpointed(search_topk(few, entries.where("size(embedding) > 0"), k, rows), "ann-exact")
    probes = choose_probes(index, few, exact, floor)
    hits = checkpointed(search(index, queries, entries, probes, k, rows), "ann-hits")
    wanted = exact.select("query_id", "entry_id")
    every, found = wanted.count(), wanted.join(hits, ["query_id", "entry_id"], "left_semi").count()
    near, all_ = compared(index, queries, probes)
    return hits, {"cells": len(index.centres), "probes": probes, "recall": found / every if every else 1.0, "compared": near, "exact_compared": all_}
