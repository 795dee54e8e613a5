"""Building blocks that keep hot keys from landing in one task.

Everything here is exact: no row is dropped or sampled. Picks per key are aggregates, so they
combine on the map side. Orders inside a possibly huge group are built in two levels: totals
per (group, bucket), a prefix sum over those few totals, then a window inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """The row with the greatest `order` per key, as an aggregate (no window, no hot task)."""
    return _pick(F.max_by, df, keys, order, keep)


def oldest(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """The row with the smallest `order` per key, as an aggregate."""
    return _pick(F.min_by, df, keys, order, keep)


def _pick(agg, df, keys, order, keep):
    keep = [c for c in (keep or df.columns) if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(agg(F.struct(*keep), F.struct(*order)).alias("__row"))
        .select(*keys, *[F.col("__row")[c].alias(c) for c in keep])
    )


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a null equals a null, so that no row with a null key is lost; keys appear once."""
    other = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(other[f"__same_{k}"])
        condition = same if condition is None else condition & same
    joined = left.join(other, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__same_{k}" for k in keys])


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    value: Column | None = None,
    name: str = "running",
    head: Column | None = None,
) -> DataFrame:
    """Running sum of `value` (1 by default, so a row number) within `group` in `order`.

    `bucket` must not decrease along `order`; it cuts a hot group into pieces that are summed and
    numbered in parallel. `head`, read from the first row of a group, is added to the whole group.
    A null in a group column is a value like any other.
    """
    value = F.lit(1).cast("bigint") if value is None else value
    keyed = df.withColumn("__bucket", bucket).withColumn("__value", value)
    parts = [F.sum("__value").alias("__total")]
    if head is not None:
        parts.append(F.min_by(head, F.struct(*order)).alias("__head"))
    totals = keyed.groupBy(*group, "__bucket").agg(*parts)
    along = W.partitionBy(*group).orderBy("__bucket")
    offset = F.coalesce(F.sum("__total").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if head is not None:
        offset = offset + F.first("__head").over(along.rowsBetween(W.unboundedPreceding, 0))
    offsets = totals.select(*group, "__bucket", offset.alias("__offset"))
    inside = W.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        join_same(keyed, offsets, [*group, "__bucket"])
        .withColumn(name, F.col("__offset") + F.sum("__value").over(inside))
        .drop("__bucket", "__value", "__offset")
    )


def hash_order(*parts: Column | str, seed: str = "") -> Column:
    """A repeatable pseudo-random order key: md5 text, the same in every engine and partitioning."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]).cast("binary"))


def hash_bucket(key: Column | str) -> Column:
    """First three hex digits of a hash order key: 4,096 even buckets in the same order."""
    return F.substring(key, 1, 3)


def spread(df: DataFrame, keys: Sequence[str], by: Column, pieces: int) -> Column:
    """A salt in [0, pieces) taken from the row's own id, so a recomputed task gives the same one."""
    return F.pmod(F.xxhash64(by), F.lit(pieces)).cast("int")


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01) -> DataFrame:
    """Keys holding at least `share` of all rows: at most 1/share of them, whatever the data."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    floor = df.agg((F.count("*") * F.lit(share)).alias("floor")).scalar()
    return counts.filter(F.col("__n") >= floor).select(*keys)


def salted_join(
    many: DataFrame, one: DataFrame, keys: Sequence[str], by: str, how: str = "inner",
    share: float = 0.01, pieces: int = 64, hot: DataFrame | None = None,
) -> DataFrame:
    """Join a skewed fact to a side with few rows per key, splitting only the hot keys.

    Hot keys (at most 1/share, so that broadcast is bounded) are spread over `pieces` salts on the
    fact side and repeated that often on the other. All other keys join as usual. A caller that
    already has key counts passes the hot keys itself, with the same bound. Null keys match each other.
    """
    hot = hot_keys(many, keys, share) if hot is None else hot
    hot = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))
    left = join_same(many, hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), spread(many, keys, F.col(by), pieces)).otherwise(0)
    )
    right = join_same(one, hot, keys, "left").withColumn(
        "__salt",
        F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))),
    )
    return join_same(left.drop("__hot"), right.drop("__hot"), [*keys, "__salt"], how).drop("__salt")


def dealt_out(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as a shuffle has, for work that takes far longer than an exchange of the rows.

    The number is given, because adaptive execution joins partitions by their bytes: short or repeated texts are few bytes but
    much work, and a file of one row group is one task. A stream keeps its partitions.
    """
    return df if df.isStreaming else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once a row, whatever refers to them later.

    A filter on a column, also one that Spark infers for an explode, moves below the projection that makes the column and repeats
    its expression there, for steps that build on each other many times over. It does not move below a generator, so the columns
    come out of one that gives each row once.
    """
    made = {f"__once_{name}": column for name, column in columns.items()}
    rows = df.select("*", F.inline(F.array(F.struct(*[column.alias(name) for name, column in made.items()]))))
    return rows.withColumns({name: F.col(f"__once_{name}") for name in columns}).drop(*made)


def left_join_nullable(left: DataFrame, right: DataFrame, keys: Sequence[str], nullable: str, by: str, pieces: int = 64) -> DataFrame:
    """Left join on keys of which `nullable` is often null on the left.

    A null key matches nothing, yet all of them would hash to one partition. They are dealt out by
    the row's own id; the extra key is always 0 on rows that can match.
    """
    dealt = left.withColumn("__deal", F.when(F.col(nullable).isNull(), F.pmod(F.xxhash64(by), F.lit(pieces))).otherwise(F.lit(0).cast("bigint")))
    matched = right.withColumn("__deal", F.pmod(F.xxhash64(nullable), F.lit(1)))  # 0, but not a constant to fold away
    return dealt.join(matched, [*keys, "__deal"], "left").drop("__deal")
