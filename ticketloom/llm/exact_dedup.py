"""Exact duplicates by content sort, with DataFrame functions only.

Texts are equal when they are identical after all white space (space, U+0009 to U+000D) is deleted. The normalised texts are
range-partitioned by sampled splitters and sorted inside each partition (Spark's external sort), so equal texts are
neighbours and a window over neighbours compares them in full. The splitters are made of a text's first characters and a hash,
so that what Spark samples for them stays small however long the texts are, and a beginning that many texts share is divided.

A text that holds more than 1/1000 of all rows would make its partition too large. Such texts (fewer than 1,000 by
construction) are found first by a count of 64-bit hashes and settled by an aggregation that combines equal texts in the task
that read them; which way a text goes changes the work, never the result: a hash shared by different texts only moves both to
the second way, which compares whole texts as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import without_spaces

#: A text is hot if its group has more than this share of all rows; at most 1/HOT_SHARE texts are.
HOT_SHARE = 1 / 1000
#: Groups of up to so many rows never count as hot: a single task takes them easily.
HOT_LEAST = 20
#: Characters of a text that take part in the splitters (the comparison always takes whole texts).
START = 32
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows and columns of `docs` with keep_id, group_size, kept and text_sha256.

    Null texts count as empty, and all empty texts form one group. The row with the most code points in its original
    text stays, then the smallest id; a null id comes after all others. Of repeated rows (same id, equal text) exactly one is
    kept. Columns of `docs` that have a name of the result are replaced. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    columns = [c for c in docs.columns if c not in RESULT]
    # a random tie-break would differ in a recomputed task; rows that agree in all of this are interchangeable
    base = docs.select(
        *columns, without_spaces(text).alias("__norm"), F.char_length(text).alias("__length"),
        F.xxhash64(without_spaces(text)).alias("__hash"),
    )
    most = max(HOT_LEAST, docs.count() * HOT_SHARE)
    hot = base.groupBy("__hash").count().where(F.col("count") > most)
    keys = [r[0] for r in hot.select("__hash").collect()]  # fewer than 1/HOT_SHARE numbers
    is_hot = F.col("__hash").isin(keys) if keys else F.lit(False)
    order = [F.col("__length").desc(), F.col(id_column).asc_nulls_last()]

    group = Window.partitionBy("__start", "__hash", "__norm").orderBy(*order)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cold = (
        base.where(~is_hot).withColumn("__start", F.substring("__norm", 1, START)).repartitionByRange("__start", "__hash")
        .select(
            *columns, F.first(id_column).over(whole).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"),
            (F.row_number().over(group) == 1).alias("kept"), F.sha2(F.col("__norm"), 256).alias("text_sha256"),
        )
    )
    if not keys:
        return cold

    rank = F.struct(-F.col("__length"), F.col(id_column).isNull(), F.col(id_column))
    rows = base.where(is_hot).withColumn("text_sha256", F.sha2(F.col("__norm"), 256))
    best = rows.groupBy("__norm").agg(F.min(rank).alias("__best"), F.count("*").alias("group_size"), F.first("text_sha256").alias("__sha"))
    best = F.broadcast(best.select("__sha", "group_size", F.col("__best")[id_column].alias("keep_id"), F.col("__best").alias("__best")))
    found = rows.join(best, rows["text_sha256"] == best["__sha"])
    # of repeated rows one stays: rows are numbered among those of the same id, so a hot group spreads over all tasks
    lead = rank.eqNullSafe(F.col("__best"))
    same = Window.partitionBy("text_sha256", id_column).orderBy(F.col("__length").desc())
    warm = found.withColumn("kept", lead & (F.row_number().over(same) == 1))
    return cold.unionByName(warm.select(*columns, "keep_id", "group_size", "kept", "text_sha256"))
