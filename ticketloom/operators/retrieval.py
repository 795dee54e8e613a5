"""Top-k retrieval of help entries by cosine similarity inside the query's tenant.

The search is exact and runs on a grid: a tenant's entries are cut into blocks and its queries
into batches of bounded size, and each (batch, block) cell is one small matrix product that
emits at most k candidates per query. No pair of vectors becomes a row, and a tenant with a third
of all queries or entries is just more cells. Candidates are merged with a per-query top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, Window as W

from ..schema import TOP_K
from ..session import shared_dir

BLOCK_ROWS = 8192
QUERY_SLICE = 256  # a slice times a block is the largest matrix a task holds
#: Every query meets every piece of its key's entries and the other way round, so small pieces are as many copies of all vectors: a
#: key with more than MOST_PIECES has larger ones, up to GROWN_ROWS.
MOST_PIECES, GROWN_ROWS = 8, 2048
TIE_DIGITS = 9  # similarities equal to this many digits are ties, broken by entry id


def _pieces(df: DataFrame, keys: Sequence[str], row_id: str, rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a piece number of about `rows` rows each, or of up to `GROWN_ROWS` where these would be more than `MOST_PIECES`,
    and the number of pieces per key."""
    size = F.least(F.greatest(F.lit(rows), F.count("*") / F.lit(MOST_PIECES)), F.lit(max(rows, GROWN_ROWS)))
    counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(f"n_{name}"))
    return df.join(counts, list(keys)).withColumn(name, F.pmod(F.xxhash64(row_id), F.col(f"n_{name}")).cast("int")).drop(f"n_{name}"), counts


def unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype("float64")
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def best_in_cell(k: int):
    """The k best entries per query of one cell, a slice of queries at a time."""

    def cell(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        return best_of(queries, entries, lambda: unit_rows(entries["embedding"]), k)

    return cell


def best_of(queries: pd.DataFrame, entries: pd.DataFrame, vectors: Callable[[], np.ndarray], k: int) -> pd.DataFrame:
    """The k best of these entries per query; `vectors` gives the entries' rows."""
    found = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "entry_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})]
    if len(queries) and len(entries):
        units, ids = vectors(), entries["entry_id"].to_numpy()
        for start in range(0, len(queries), QUERY_SLICE):
            part = queries.iloc[start : start + QUERY_SLICE]
            found.append(_best(part["query_id"].to_numpy(), np.round(unit_rows(part["embedding"]) @ units.T, TIE_DIGITS), ids, k))
    return pd.concat(found)


def _best(query_ids: np.ndarray, similarity: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    keep = min(k, similarity.shape[1])
    # everything at least as similar as the k-th best, so ties at the edge are all seen
    edge = np.partition(similarity, similarity.shape[1] - keep, axis=1)[:, similarity.shape[1] - keep]
    row, col = np.nonzero(similarity >= edge[:, None])
    order = np.lexsort((ids[col], -similarity[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k  # position within its own query
    row, col = row[first], col[first]
    return pd.DataFrame({"query_id": query_ids[row], "entry_id": ids[col], "similarity": similarity[row, col]})


def grid(queries: DataFrame, entries: DataFrame, keys: Sequence[str], best: Callable, rows: int) -> DataFrame:
    """Candidates (query_id, entry_id, similarity): what `best` finds in every grid cell. Entries without a query are not listed."""
    batches, n_batches = _pieces(queries, keys, "query_id", rows, "batch")
    blocks, n_blocks = _pieces(entries, keys, "entry_id", rows, "block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = batches.join(n_blocks, list(keys)).withColumn("block", every("n_block")).drop("n_block")
    right = blocks.join(n_batches, list(keys)).withColumn("batch", every("n_batch")).drop("n_batch")
    cell = [*keys, "batch", "block"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(best, "query_id bigint, entry_id bigint, similarity double")


def merge(candidates: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_id")
    return (
        candidates.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .withColumn("similarity", F.round("similarity", 4))
    )


def search_topk(queries: DataFrame, entries: DataFrame, k: int = TOP_K, rows: int = BLOCK_ROWS) -> DataFrame:
    """The k entries of the query's tenant closest to each query: (query_id, entry_id, rank, similarity)."""
    q = queries.select("query_id", "tenant_id", "embedding")
    e = entries.select("entry_id", "tenant_id", "embedding")
    return merge(grid(q, e, ["tenant_id"], best_in_cell(k), rows), k)


def search_cells(
    queries: DataFrame, entries: DataFrame, k: int = TOP_K, cells: int = 16, probes: int = 4, rows: int = BLOCK_ROWS, seed: int = 7
) -> DataFrame:
    """Approximate search for large collections: entries are clustered into cells and a query
    looks only into its `probes` nearest cells, exactly within them. `probes = cells` is exact."""
    q, e = _in_cells(queries, entries, cells, seed)
    return _probe(q, e, k, probes, rows)


def search_to_recall(
    queries: DataFrame, entries: DataFrame, k: int = TOP_K, floor: float = 0.9, rows: int = BLOCK_ROWS, folder: str | None = None
) -> DataFrame:
    """Approximate search that finds at least the share `floor` of the exact hits of the measuring queries, over an index that
    is saved below `folder` (`ann.search_measured`, which also gives the figures)."""
    from .ann import search_measured

    return search_measured(entries, queries, folder or shared_dir(entries.sparkSession, "ann"), k, (1 + floor) / 2, rows)[0]


def _in_cells(queries: DataFrame, entries: DataFrame, cells: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Queries with `order`, all cells from the nearest on, and entries with their `cell`."""
    vectors = entries.select("entry_id", "tenant_id", "embedding", array_to_vector("embedding").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(vectors)
    centres = np.asarray(model.clusterCenters())  # cells x dimension

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype("float64")
        far = (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
        return pd.Series(list(np.argsort(far, axis=1, kind="stable").astype("int32")))

    q = queries.select("query_id", "tenant_id", "embedding", nearest("embedding").alias("order"))
    return q, model.transform(vectors).select("entry_id", "tenant_id", "embedding", F.col("prediction").alias("cell"))


def _probe(q: DataFrame, e: DataFrame, k: int, probes: int, rows: int) -> DataFrame:
    q = q.select("query_id", "tenant_id", "embedding", F.explode(F.slice("order", 1, probes)).alias("cell"))
    return merge(grid(q, e, ["tenant_id", "cell"], best_in_cell(k), rows), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact hits the approximate search found."""
    found = approximate.select("query_id", "entry_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "entry_id"], "left").agg(
        F.count("*").alias("hits"), F.count("hit").alias("found"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall")
    )


def relevance(hits: DataFrame, queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits with the query's category and whether the entry's tags contain it."""
    return (
        hits.join(queries.select("query_id", "category"), "query_id")
        .join(entries.select("entry_id", "tags"), "entry_id")
        .withColumn("relevant", F.coalesce(F.array_contains("tags", F.col("category")), F.lit(False)))
        .drop("tags")
    )


def first_relevant_rank(relevant_hits: DataFrame) -> DataFrame:
    return relevant_hits.groupBy("query_id", "category").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"))


def retrieval_metrics(first_ranks: DataFrame) -> DataFrame:
    """hit@1, hit@k and mean reciprocal rank per category and overall (category null)."""
    rank = F.col("first_rank")
    return first_ranks.rollup("category").agg(
        F.count("*").alias("queries"),
        F.avg(F.coalesce((rank == 1).cast("double"), F.lit(0.0))).alias("hit_at_1"),
        F.avg(rank.isNotNull().cast("double")).alias("hit_at_k"),
        F.avg(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr"),
    )


def embed_texts(df: DataFrame, text: str = "text", dim: int = 64, encoder=None) -> DataFrame:
    """Adds a unit-length `embedding`. The default encoder hashes words on the JVM.

    `encoder` (a frame with `text` -> the same plus `embedding`) is the hook for a real model; it
    sees each distinct text once, and vectors are joined back by fingerprint.
    """
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    if encoder is None:
        words = df.withColumn("__words", F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))
        counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dim).transform(words)
        unit = Normalizer(inputCol="__tf", outputCol="__unit").transform(counted)
        return unit.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")

    from .scale import salted_join

    keyed = df.withColumns({"__key": F.sha2(F.col(text).cast("binary"), 256), "__row": F.xxhash64(*df.columns)})
    distinct = keyed.groupBy("__key").agg(F.first(text).alias("text"))
    vectors = encoder(distinct).select("__key", "embedding")
    return salted_join(keyed, vectors, ["__key"], "__row").drop("__key", "__row")
