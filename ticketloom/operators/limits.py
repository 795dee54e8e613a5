"""Sliding-window rate limits over an attempt log, exact and without one task per key.

A limiter allows an attempt when fewer than `limit` attempts of its key were allowed in the
window before it; refused attempts leave no trace. That is sequential per key, but only where
it matters:

1. attempts are counted per (key, instant), which combines on the map side;
2. an instant whose window holds at most `limit` attempts of any kind is allowed whatever came
   before, and this count needs no order between tasks;
3. only stretches with fuller windows are folded. A window-long pause without such instants makes
   the state known again, so every stretch is folded on its own.

Limiters that are asked one after the other and whose keys lie inside each other share one fold (`in_turn`); independent keys
have one each (`login_decisions`). A key under steady attack, with a full window in every bucket, is one sequential fold: its
verdicts depend on each other without a break.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from ..session import checkpointed


def trailing_counts(attempts: DataFrame, key: str, seconds: int) -> DataFrame:
    """Per (key, instant): attempts `n` and attempts `trailing` in the window ending there.

    Time is cut into window-long buckets, so a key's history is spread over them instead of sorted in one task. Every instant
    enters its own bucket at its time and leaves the next one a window later; the count of a window is what the bucket before
    held, plus the running sum of these changes. Each row is added once, however many lie in a window.
    """
    width = seconds * 1_000_000
    instants = attempts.groupBy(F.col(key).alias("key"), F.unix_micros("ts").alias("at")).agg(F.count("*").alias("n"))
    own = instants.withColumn("bucket", F.floor(F.col("at") / F.lit(width)).cast("bigint"))
    enters = F.struct(F.col("bucket").alias("into"), F.col("at").alias("moment"), F.col("n").alias("change"))
    leaves = F.struct((F.col("bucket") + 1).alias("into"), (F.col("at") + width).alias("moment"), (-F.col("n")).alias("change"))
    spread = own.withColumn("move", F.explode(F.array(enters, leaves))).select("key", "bucket", "at", "n", "move.*")
    whole = W.partitionBy("key", "into")
    before = F.coalesce(F.sum(F.when(F.col("change") < 0, -F.col("change"))).over(whole), F.lit(0))
    # what leaves at an instant is out of the window that ends there
    moved = F.sum("change").over(whole.orderBy("moment").rangeBetween(W.unboundedPreceding, W.currentRow))
    return (
        spread.withColumn("trailing", before + moved)
        .filter(F.col("into") == F.col("bucket"))
        .select("key", "bucket", "at", "n", "trailing")
    )


def suspects(attempts: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """Instants at which a key has more than `limit` attempts in its window."""
    return trailing_counts(attempts, key, seconds).filter(F.col("trailing") > limit)


def _marked(attempts: DataFrame, limiters: Sequence[tuple[str, int]], seconds: int) -> DataFrame:
    """Buckets that must be folded: (outer, bucket, stretch, full).

    Neighbouring buckets in which some limiter has a full window form a stretch, named by its first bucket; the bucket before
    it is context (`full` is false): there every attempt was allowed.
    """
    outer = limiters[-1][0]
    full = None
    for key, limit in limiters:
        both = F.struct(F.col(outer).alias("outer"), F.col(key).alias("inner"))
        crowded = trailing_counts(attempts.withColumn("__both", both), "__both", seconds).filter(F.col("trailing") > limit)
        found = crowded.select(F.col("key.outer").alias("outer"), "bucket")
        full = found if full is None else full.unionByName(found)
    # one row per (key, window-long bucket), not per attempt
    along = W.partitionBy("outer").orderBy("bucket")
    islands = full.distinct().withColumn("run", F.col("bucket") - F.row_number().over(along))
    marked = islands.select("outer", "bucket", F.min("bucket").over(W.partitionBy("outer", "run")).alias("stretch"), F.lit(True).alias("full"))
    return marked.unionByName(marked.filter("bucket = stretch").select("outer", (F.col("bucket") - 1).alias("bucket"), "stretch", F.lit(False).alias("full")))


class Chain:
    """Limiters asked one after the other, for attempts in the order of their times.

    A limiter remembers the attempts it allowed even if a later one refused them, and is not asked when an earlier one refused.
    Only times of the last window are held.
    """

    def __init__(self, limits: Sequence[int], width: int):
        self.limits, self.width = limits, width
        self.held: list[dict] = [{} for _ in limits]
        self.recent: list[deque] = [deque() for _ in limits]

    def ask(self, at: int, keys: Sequence, resets: bool) -> int:
        """0 if the attempt is allowed, else the number of the limiter that refused it. An allowed one that `resets` clears the
        first limiter's key."""
        for n, (key, limit) in enumerate(zip(keys, self.limits)):
            held, recent = self.held[n], self.recent[n]
            while recent and recent[0][0] <= at - self.width:
                old, name = recent.popleft()
                times = held.get(name)
                if times and times[0] == old:
                    times.popleft()
                    if not times:
                        del held[name]
            times = held.setdefault(key, deque())
            if len(times) >= limit:
                return n + 1
            times.append(at)
            recent.append((at, key))
        if resets:
            self.held[0].pop(keys[0], None)
            self.recent[0] = deque(r for r in self.recent[0] if r[1] != keys[0])
        return 0


def fold_stretches(limits: Sequence[int], width: int):
    """Verdicts for attempts sorted by (outer, stretch, at, order): one pass over any number of stretches."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain = None, None
        for batch in batches:
            where = batch.schema.get_field_index
            read = lambda name: batch.column(where(name)).to_pylist()
            refused = []
            for outer, stretch, at, resets, *keys in zip(read("__outer"), read("stretch"), read("__at"), read("__resets"), *(read(f"__key{n}") for n in range(len(limits)))):
                if (outer, stretch) != current:
                    current, chain = (outer, stretch), Chain(limits, width)
                refused.append(chain.ask(at, keys, resets))
            columns = [*batch.columns, pa.array(refused, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "refused_by"]).filter(batch.column(where("full")))

    return fold


def in_turn(attempts: DataFrame, limiters: Sequence[tuple[str, int]], seconds: int, order: str = "attempt_id", resets: str | None = None) -> DataFrame:
    """Every attempt with `refused_by`: 0 if all limiters (key column, limit) allow it, else the number of the one that refused.

    The limiters are asked in this order, in one fold. Keys of the earlier limiters are told apart within the last one's key (a
    visitor of one business is not the visitor of another). At one instant, attempts are taken in `order`. `resets` names a boolean column: an attempt that all
    allow clears the first limiter's key if it is true. A null key is a key like any other.
    """
    width = seconds * 1_000_000
    names, own = attempts.columns, {f"__key{n}": F.col(key) for n, (key, _) in enumerate(limiters)}
    at = F.unix_micros("ts")
    flag = F.coalesce(F.col(resets), F.lit(False)) if resets else F.lit(False)
    keyed = attempts.withColumns({**own, "__outer": F.col(limiters[-1][0]), "__at": at, "__bucket": F.floor(at / F.lit(width)).cast("bigint"), "__resets": flag})
    marked = _marked(attempts, limiters, seconds)
    met = keyed.join(marked, F.col("__outer").eqNullSafe(F.col("outer")) & (F.col("__bucket") == F.col("bucket")), "left")
    certain = met.where("full IS NULL OR NOT full").select(*names, F.lit(0).alias("refused_by"))
    folded = met.where("stretch IS NOT NULL").drop("outer", "bucket").repartition("__outer", "stretch").sortWithinPartitions("__outer", "stretch", "__at", order)
    schema = T.StructType([*folded.schema.fields, T.StructField("refused_by", T.IntegerType())])
    return certain.unionByName(folded.mapInArrow(fold_stretches([n for _, n in limiters], width), schema).select(*names, "refused_by"))


def decisions(attempts: DataFrame, key: str, limit: int, seconds: int, order: str = "attempt_id", resets: str | None = None) -> DataFrame:
    """Every attempt with `allowed`. At one instant, attempts are taken in `order`."""
    return in_turn(attempts, [(key, limit)], seconds, order, resets).withColumn("allowed", F.col("refused_by") == 0).drop("refused_by")


def contact_decisions(
    attempts: DataFrame, visitor_limit: int = 5, business_limit: int = 100, seconds: int = 3600
) -> DataFrame:
    """Both contact-form limits in sequence, in one fold; the business is only asked when the visitor may send."""
    verdict = F.when(F.col("refused_by") == 1, "visitor limit").when(F.col("refused_by") == 2, "business limit").otherwise("allowed")
    both = in_turn(attempts, [("visitor", visitor_limit), ("business", business_limit)], seconds)
    return both.select("attempt_id", "business", "visitor", "ts", verdict.alias("verdict"))


def login_decisions(
    attempts: DataFrame, email: str = "email", address: str = "address", limit: int = 10, address_times: int = 5, seconds: int = 900,
    order: str = "attempt_id", succeeded: str | None = None,
) -> DataFrame:
    """Every attempt with its `verdict`: the e-mail limiter is asked first, then the address limiter, whose limit is
    `address_times` as high.

    The keys are independent of each other, so each limiter has its own fold. With `succeeded` (the password was right), an
    attempt that both allow clears its e-mail's count. Whether it does depends on the address limiter, which depends on the
    e-mail limiter: the two are repeated until no clearing changes. Every verdict depends on earlier attempts only, so each
    round settles at least the earliest open one, and the last round's verdicts are those of the sequence.
    """
    names = attempts.columns
    tried = attempts.withColumn("__clears", F.coalesce(F.col(succeeded), F.lit(False)) if succeeded else F.lit(False))
    while True:
        first = checkpointed(in_turn(tried, [(email, limit)], seconds, order, "__clears"), "login-email")
        passed = in_turn(first.where("refused_by = 0").drop("refused_by"), [(address, limit * address_times)], seconds, order)
        both = checkpointed(
            passed.withColumn("verdict", F.when(F.col("refused_by") == 0, "allowed").otherwise("address limit")).drop("refused_by").unionByName(
                first.where("refused_by <> 0").drop("refused_by").withColumn("verdict", F.lit("email limit"))
            ),
            "login-both",
        )
        if not succeeded:
            return both.select(*names, "verdict")
        # an attempt that the address limiter refused clears nothing; one that the e-mail limiter refused is not asked about it
        clears = F.coalesce(F.col(succeeded), F.lit(False)) & (F.col("verdict") != "address limit")
        if both.where(F.col("__clears") != clears).isEmpty():
            return both.select(*names, "verdict")
        tried = both.withColumn("__clears", clears).drop("verdict")
