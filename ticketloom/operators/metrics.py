"""Service metrics per tenant: counts, rates, daily series, review outcomes, resolution times.

All operators take every tenant at once. Counts are conditional aggregates, so a hot tenant is
reduced on the map side to one row per task; zero rows come from exploding the enum values.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import utc_day
from ..schema import CATEGORIES, ORDER_STATUSES, TICKET_STATUSES

OUTCOMES = ("approved_as_is", "edited")


def escalated() -> Column:
    return F.count_if(F.col("needs_escalation")).alias("escalated")


def decided(name: str = "decided") -> Column:
    """Tickets with a decision: the flag is set, either way."""
    return F.count("needs_escalation").alias(name)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _zero_filled(df: DataFrame, tenants: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Count per tenant and enum value with every value present."""
    wide = df.groupBy("tenant_id").agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    cells = F.array(*[F.struct(F.lit(v).alias(column), F.coalesce(F.col(v), F.lit(0)).alias("n")) for v in values])
    return (
        tenants.select("tenant_id")
        .join(wide, "tenant_id", "left")
        .select("tenant_id", F.explode(cells).alias("cell"))
        .select("tenant_id", f"cell.{column}", "cell.n")
    )


def tickets_by_status(tickets: DataFrame, tenants: DataFrame) -> DataFrame:
    return _zero_filled(tickets, tenants, "status", TICKET_STATUSES)


def tickets_by_category(tickets: DataFrame, tenants: DataFrame) -> DataFrame:
    """Counts by the model's category; tickets without one are left out."""
    return _zero_filled(tickets, tenants, "category", CATEGORIES)


def escalation_rate(tickets: DataFrame, tenants: DataFrame) -> DataFrame:
    counts = tickets.groupBy("tenant_id").agg(decided(), escalated())
    return (
        tenants.select("tenant_id")
        .join(counts, "tenant_id", "left")
        .select(
            "tenant_id",
            F.coalesce("decided", F.lit(0)).alias("decided"),
            F.coalesce("escalated", F.lit(0)).alias("escalated"),
            ratio(F.col("escalated"), F.col("decided")).alias("rate"),
        )
    )


def escalation_by_day(tickets: DataFrame, tenants: DataFrame, today: date, days: int) -> DataFrame:
    """Decided and escalated tickets per UTC day created, for `days` days ending `today`.

    The lower bound is a plain timestamp comparison, so it reaches the scan.
    """
    start = today - timedelta(days=days - 1)
    since = F.lit(datetime.combine(start, time.min, timezone.utc))
    until = F.lit(datetime.combine(today + timedelta(days=1), time.min, timezone.utc))
    counts = (
        tickets.filter((F.col("created_at") >= since) & (F.col("created_at") < until))
        .groupBy("tenant_id", utc_day("created_at").alias("day"))
        .agg(decided("processed"), escalated())
    )
    spine = tenants.select("tenant_id", F.explode(F.sequence(F.lit(start), F.lit(today))).alias("day"))
    return spine.join(counts, ["tenant_id", "day"], "left").select(
        "tenant_id",
        "day",
        F.coalesce("processed", F.lit(0)).alias("processed"),
        F.coalesce("escalated", F.lit(0)).alias("escalated"),
        ratio(F.col("escalated"), F.col("processed")).alias("rate"),
    )


def reviewed_drafts(drafts: DataFrame, tickets: DataFrame) -> DataFrame:
    """Approved drafts with their ticket's flag, category and seconds from creation to review."""
    approved = drafts.filter(F.col("approved")).select(
        "tenant_id", "ticket_id", F.col("edited_text").isNotNull().alias("edited"), "reviewed_at"
    )
    of_ticket = tickets.select(
        "tenant_id", "ticket_id", "category", "created_at", F.coalesce("needs_escalation", F.lit(False)).alias("flagged")
    )
    seconds = (F.unix_micros("reviewed_at") - F.unix_micros("created_at")) / F.lit(1e6)
    return approved.join(of_ticket, ["tenant_id", "ticket_id"]).select(
        "tenant_id", "ticket_id", "category", "edited", "flagged", seconds.alias("seconds")
    )


def review_outcomes(reviewed: DataFrame, tenants: DataFrame) -> DataFrame:
    """Approved drafts by outcome (as is, edited) and whether the ticket was escalated."""
    cell = lambda edited, flagged: F.count_if((F.col("edited") == edited) & (F.col("flagged") == flagged))
    wide = reviewed.groupBy("tenant_id").agg(
        cell(False, True).alias("as_is_esc"), cell(False, False).alias("as_is_not"),
        cell(True, True).alias("edited_esc"), cell(True, False).alias("edited_not"),
    )
    row = lambda name, esc, no: F.struct(
        F.lit(name).alias("outcome"),
        F.coalesce(F.col(esc), F.lit(0)).alias("escalated"),
        F.coalesce(F.col(no), F.lit(0)).alias("not_escalated"),
    )
    return (
        tenants.select("tenant_id")
        .join(wide, "tenant_id", "left")
        .select("tenant_id", F.inline(F.array(row(OUTCOMES[0], "as_is_esc", "as_is_not"), row(OUTCOMES[1], "edited_esc", "edited_not"))))
    )


def approval_rate(reviewed: DataFrame, tenants: DataFrame) -> DataFrame:
    counts = reviewed.groupBy("tenant_id").agg(F.count("*").alias("reviewed"), F.count_if(~F.col("edited")).alias("as_is"))
    return (
        tenants.select("tenant_id")
        .join(counts, "tenant_id", "left")
        .select(
            "tenant_id",
            F.coalesce("reviewed", F.lit(0)).alias("reviewed"),
            F.coalesce("as_is", F.lit(0)).alias("as_is"),
            ratio(F.col("as_is"), F.col("reviewed")).alias("rate"),
        )
    )


def resolution_by_category(reviewed: DataFrame, tenants: DataFrame) -> DataFrame:
    """Approved drafts and mean seconds to approval per category, every category present."""
    totals = reviewed.filter(F.col("category").isNotNull()).groupBy("tenant_id", "category").agg(
        F.count("*").alias("resolved"), F.avg("seconds").alias("avg_seconds")
    )
    spine = tenants.select("tenant_id", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    return spine.join(totals, ["tenant_id", "category"], "left").select(
        "tenant_id", "category", F.coalesce("resolved", F.lit(0)).alias("resolved"), "avg_seconds"
    )


def resolution_overall(reviewed: DataFrame, tenants: DataFrame) -> DataFrame:
    """Mean seconds to approval, weighted by count; tickets without a category do not count."""
    totals = reviewed.filter(F.col("category").isNotNull()).groupBy("tenant_id").agg(
        F.count("*").alias("resolved"), F.avg("seconds").alias("avg_seconds")
    )
    return (
        tenants.select("tenant_id")
        .join(totals, "tenant_id", "left")
        .select("tenant_id", F.coalesce("resolved", F.lit(0)).alias("resolved"), "avg_seconds")
    )


def metrics_summary(tickets: DataFrame, reviewed: DataFrame, tenants: DataFrame, today: date, days: int) -> DataFrame:
    """The whole dashboard, one nested row per tenant, from one scan of the tickets.

    Grouping sets reduce the tickets to at most (statuses + categories + days + 1) rows per tenant
    before anything is nested, so the nested row has a fixed bound.
    """
    start = today - timedelta(days=days - 1)
    in_window = (F.col("day") >= F.lit(start)) & (F.col("day") <= F.lit(today))
    base = tickets.select("tenant_id", "status", "category", utc_day("created_at").alias("day"), "needs_escalation")
    base = base.withColumn("day", F.when(in_window, F.col("day")))
    sets = base.groupingSets(
        [["tenant_id"], ["tenant_id", "status"], ["tenant_id", "category"], ["tenant_id", "day"]],
        "tenant_id", "status", "category", "day",
    ).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), decided(), escalated(),
    )
    # grouping_id has one bit per column (tenant, status, category, day), 1 = rolled up
    def lookup(gid: int, key: str, *values: str) -> Column:
        entry = F.struct(F.col(key).cast("string").alias("k"), F.struct(*values).alias("v"))
        return F.map_from_entries(F.collect_list(F.when((F.col("gid") == gid) & F.col(key).isNotNull(), entry)))

    per_tenant = sets.groupBy("tenant_id").agg(
        F.max(F.when(F.col("gid") == 7, F.struct("n", "decided", "escalated"))).alias("total"),
        lookup(3, "status", "n").alias("by_status"),
        lookup(5, "category", "n").alias("by_category"),
        lookup(6, "day", "decided", "escalated").alias("by_day"),
    )
    outcome = reviewed.groupBy("tenant_id").agg(
        F.count("*").alias("reviewed"),
        F.count_if(~F.col("edited")).alias("as_is"),
        *[
            F.count_if((F.col("edited") == e) & (F.col("flagged") == f)).alias(f"o_{int(e)}{int(f)}")
            for e in (False, True) for f in (True, False)
        ],
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES],
        *[F.avg(F.when(F.col("category") == c, F.col("seconds"))).alias(f"s_{c}") for c in CATEGORIES],
        F.avg(F.when(F.col("category").isNotNull(), F.col("seconds"))).alias("avg_seconds"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    counted = lambda m, values, name: F.array(
        *[F.struct(F.lit(v).alias(name), zero(F.try_element_at(F.col(m), F.lit(v))["n"]).alias("n")) for v in values]
    )
    day_list = F.transform(
        F.sequence(F.lit(start), F.lit(today)),
        lambda d: F.struct(
            d.alias("day"),
            zero(F.try_element_at("by_day", d.cast("string"))["decided"]).alias("processed"),
            zero(F.try_element_at("by_day", d.cast("string"))["escalated"]).alias("escalated"),
        ),
    )
    return (
        tenants.select("tenant_id")
        .join(per_tenant, "tenant_id", "left")
        .join(outcome, "tenant_id", "left")
        .select(
            "tenant_id",
            zero(F.col("total.n")).alias("total_tickets"),
            counted("by_status", TICKET_STATUSES, "status").alias("tickets_by_status"),
            counted("by_category", CATEGORIES, "category").alias("tickets_by_category"),
            ratio(F.col("total.escalated"), F.col("total.decided")).alias("escalation_rate"),
            day_list.alias("escalation_by_day"),
            zero(F.col("reviewed")).alias("drafts_reviewed"),
            ratio(F.col("as_is"), F.col("reviewed")).alias("approval_rate"),
            F.array(
                *[
                    F.struct(F.lit(name).alias("outcome"), zero(F.col(f"o_{e}1")).alias("escalated"), zero(F.col(f"o_{e}0")).alias("not_escalated"))
                    for e, name in enumerate(OUTCOMES)
                ]
            ).alias("review_outcomes"),
            F.col("avg_seconds").alias("avg_resolution_seconds"),
            F.array(
                *[
                    F.struct(F.lit(c).alias("category"), zero(F.col(f"n_{c}")).alias("resolved"), F.col(f"s_{c}").alias("avg_seconds"))
                    for c in CATEGORIES
                ]
            ).alias("resolution_by_category"),
        )
    )


def summary_long(summary: DataFrame) -> DataFrame:
    """The nested summary as (tenant_id, metric, item, value) rows."""
    d = lambda c: c.cast("double")
    cell = lambda metric, item, value: F.struct(F.lit(metric).alias("metric"), item.cast("string").alias("item"), d(value).alias("value"))
    one = lambda metric, column: F.array(cell(metric, F.lit(""), F.col(column)))
    many = lambda column, key, value: F.transform(column, lambda x: cell(f"{column}.{value}", x[key], x[value]))
    cells = F.concat(
        *[one(m, m) for m in ("total_tickets", "escalation_rate", "drafts_reviewed", "approval_rate", "avg_resolution_seconds")],
        many("tickets_by_status", "status", "n"),
        many("tickets_by_category", "category", "n"),
        many("escalation_by_day", "day", "processed"),
        many("escalation_by_day", "day", "escalated"),
        many("review_outcomes", "outcome", "escalated"),
        many("review_outcomes", "outcome", "not_escalated"),
        many("resolution_by_category", "category", "resolved"),
        many("resolution_by_category", "category", "avg_seconds"),
    )
    return summary.select("tenant_id", F.inline(cells))


def order_status_mix(orders: DataFrame, threshold: float = 100) -> DataFrame:
    """Orders per tenant and status, and how many cost more than the refund threshold."""
    return orders.groupBy("tenant_id", "status").agg(
        F.count("*").alias("n"), F.count_if(F.col("amount") > F.lit(threshold)).alias("over_threshold")
    )


def queue_counts(tickets: DataFrame) -> DataFrame:
    waiting = F.col("status") == "awaiting_review"
    return tickets.groupBy("tenant_id").agg(
        F.count_if(waiting).alias("awaiting_review"),
        F.count_if(waiting & F.col("needs_escalation")).alias("awaiting_escalated"),
        F.count_if(F.col("status").isin("new", "in_progress")).alias("with_agents"),
    )


def chart_shares(by_category: DataFrame) -> DataFrame:
    """Share of each category in its tenant's classified tickets."""
    totals = by_category.groupBy("tenant_id").agg(F.sum("n").alias("total"))
    return by_category.join(totals, "tenant_id").select(
        "tenant_id", "category", "n", "total", ratio(F.col("n"), F.col("total")).alias("share")
    )


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Review outcomes with escalated and not escalated drafts added up."""
    return outcomes.withColumn("total", F.col("escalated") + F.col("not_escalated"))


def tenant_overview(tenants: DataFrame, users: DataFrame, tickets: DataFrame) -> DataFrame:
    """Users and tickets per tenant. Each side is counted before the join, so nothing fans out."""
    count = lambda df, name: df.groupBy("tenant_id").agg(F.count("*").alias(name))
    return (
        tenants.select("tenant_id", "slug", "name")
        .join(count(users, "users"), "tenant_id", "left")
        .join(count(tickets, "tickets"), "tenant_id", "left")
        .na.fill(0, ["users", "tickets"])
    )


def agent_step_latency(logs: DataFrame) -> DataFrame:
    """Runs, errors and duration statistics per step.

    Percentiles are exact: equal durations are counted first, so one step's buffer is bounded by
    its distinct millisecond values and not by its log lines.
    """
    failed = F.get_json_object("output", "$.error").isNotNull()
    counted = logs.groupBy("agent_name", "duration_ms").agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    pct = lambda p: F.percentile("duration_ms", F.lit(p), F.col("n"))
    return counted.groupBy("agent_name").agg(
        F.sum("n").alias("runs"),
        F.sum("failed").alias("errors"),
        (F.sum(F.col("duration_ms") * F.col("n")) / F.sum(F.when(F.col("duration_ms").isNotNull(), F.col("n")))).alias("avg_ms"),
        pct(0.5).alias("p50_ms"),
        pct(0.95).alias("p95_ms"),
    )


def draft_provider_stats(logs: DataFrame) -> DataFrame:
    """Attempts per provider of the fallback chain and mean tokens of the drafts it wrote."""
    shape = (
        "struct<usage:struct<input_tokens:bigint,output_tokens:bigint>,"
        "attempts:array<struct<provider:string,ok:string,error:string,skipped:string>>>"
    )
    attempts = (
        logs.filter(F.col("agent_name") == "draft")
        .select(F.from_json("output", shape).alias("o"))
        .select("o.usage", F.explode("o.attempts").alias("a"))
    )
    drafted = F.col("a.ok").isNotNull()
    return attempts.groupBy(F.col("a.provider").alias("provider")).agg(
        F.count("*").alias("attempts"),
        F.count_if(drafted).alias("drafted"),
        F.count_if(F.col("a.error").isNotNull()).alias("failed"),
        F.count_if(F.col("a.skipped").isNotNull()).alias("skipped"),
        F.avg(F.when(drafted, F.col("usage.input_tokens"))).alias("avg_input_tokens"),
        F.avg(F.when(drafted, F.col("usage.output_tokens"))).alias("avg_output_tokens"),
    )
