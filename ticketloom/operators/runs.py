"""Processing runs reconstructed from a ticket's step log, and readings of the log JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import STEPS
from .scale import newest, running_sum


def error_of(output: Column) -> Column:
    return F.get_json_object(output, "$.error")


def numbered_logs(logs: DataFrame) -> DataFrame:
    """Logs with the number of the run they belong to.

    A triage log opens a run, and so does a ticket's first log whatever its step: a ticket that
    does not start with triage counts one more. Run numbers are a running count of triage logs, summed
    per hour before they are numbered inside an hour.
    """
    triage = (F.col("agent_name") == "triage").cast("bigint")
    return running_sum(logs, ["ticket_id"], ["created_at", "log_id"], F.date_trunc("hour", "created_at"), triage, "run_no", head=1 - triage)


def agent_runs(logs: DataFrame) -> DataFrame:
    """One row per run: logs, whether it finished (escalation reached or an error) or failed."""
    failed = error_of(F.col("output")).isNotNull()
    return (
        numbered_logs(logs)
        .groupBy("ticket_id", "run_no")
        .agg(
            F.count("*").alias("logs"),
            F.bool_or((F.col("agent_name") == "escalation") | failed).alias("finished"),
            F.bool_or(failed).alias("failed"),
            F.min("created_at").alias("started_at"),
            F.collect_set("agent_name").alias("steps"),  # at most five names
        )
    )


def current_run(tickets: DataFrame, runs: DataFrame) -> DataFrame:
    """The run to show: the latest, or an empty next one while the agents work and it is finished."""
    last = newest(runs, ["ticket_id"], ["run_no"], ["run_no", "logs", "finished", "failed"])
    running = F.col("status").isin("new", "in_progress")
    empty = F.col("run_no").isNull() | (running & F.col("finished"))
    return (
        tickets.select("tenant_id", "ticket_id", "status")
        .join(last, "ticket_id", "left")
        .select(
            "tenant_id", "ticket_id",
            F.when(empty, F.coalesce("run_no", F.lit(0)) + 1).otherwise(F.col("run_no")).alias("run_no"),
            F.when(empty, F.lit(0)).otherwise(F.col("logs")).alias("logs"),
            F.when(empty, F.lit(False)).otherwise(F.col("finished")).alias("finished"),
            F.when(empty, F.lit(False)).otherwise(F.col("failed")).alias("failed"),
        )
    )


def missing_steps(tickets: DataFrame, runs: DataFrame) -> DataFrame:
    """Expected steps a run has not logged; order lookup is expected only with a linked order."""
    every = F.array(*map(F.lit, STEPS))
    expected = F.when(F.col("order_id").isNotNull(), every).otherwise(F.array_remove(every, "order_lookup"))
    return runs.join(tickets.select("ticket_id", "order_id"), "ticket_id").select(
        "ticket_id", "run_no", F.explode(F.array_except(expected, F.col("steps"))).alias("step")
    )


def trace_in_order(logs: DataFrame) -> DataFrame:
    return logs.orderBy("ticket_id", "created_at", "log_id")


LOG_SHAPE = (
    "struct<category:struct<label:string,confidence:double>,urgency:struct<label:string,confidence:double>,"
    "retrieved:array<struct<id:string,title:string,similarity:double>>,"
    "decision:struct<needs_escalation:boolean,reason:string>,mode:string,model:string,error:string>"
)


def log_fields(logs: DataFrame) -> DataFrame:
    """Typed fields of the log JSON; whatever is missing is null."""
    # `result` is an object or a plain text, so it is read by path and not by schema
    o = F.from_json("output", LOG_SHAPE)
    item = lambda field: F.get_json_object("output", f"$.result.{field}")
    parsed = logs.withColumn("o", o)
    return parsed.select(
        "log_id", "ticket_id", "agent_name",
        F.col("o.category.label").alias("category"), F.col("o.category.confidence").alias("category_confidence"),
        F.col("o.urgency.label").alias("urgency"), F.col("o.urgency.confidence").alias("urgency_confidence"),
        F.coalesce(F.size("o.retrieved"), F.lit(0)).alias("hits"),
        F.col("o.decision.needs_escalation").alias("needs_escalation"),
        item("item_name").alias("item_name"), item("status").alias("order_status"),
        F.col("o.mode").alias("mode"), F.col("o.model").alias("model"),
        F.col("o.error").alias("error"),
    )


def spoken(name: Column) -> Column:
    """An enum value as words with a capital: refund_request -> Refund request."""
    words = F.translate(name, "_", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def trace_headline(fields: DataFrame) -> DataFrame:
    """One line per step: what it concluded."""
    c = F.col
    line = (
        F.when(
            c("agent_name") == "triage",
            F.coalesce(F.concat(spoken(c("category")), F.lit(", "), c("urgency"), F.lit(" urgency")), F.lit("Classified")),
        )
        .when(
            c("agent_name") == "knowledge",
            F.concat(F.lit("Found "), c("hits").cast("string"), F.when(c("hits") == 1, " knowledge-base entry").otherwise(" knowledge-base entries")),
        )
        .when(
            c("agent_name") == "order_lookup",
            F.coalesce(F.concat(c("item_name"), F.lit(", "), c("order_status")), F.lit("No order found")),
        )
        .when(
            c("agent_name") == "draft",
            F.when(c("mode") == "offline", "Wrote a placeholder draft (no LLM configured)").otherwise(
                F.concat(F.lit("Drafted a reply with "), F.coalesce(c("model"), F.lit("the LLM")))
            ),
        )
        .when(c("agent_name") == "escalation", F.when(c("needs_escalation"), "Flagged for escalation").otherwise("No escalation needed"))
    )
    return fields.select("log_id", "ticket_id", "agent_name", line.alias("headline"))
