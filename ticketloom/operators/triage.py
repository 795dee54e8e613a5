"""Batch triage: labels, order facts, retrieved entries and the escalation decision in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import with_decision, with_rules
from ..functions.text import mask_contact, ticket_text
from .scale import left_join_nullable
from .tickets import with_order

FAILED = "Agent pipeline failed ({0}); review manually or rerun"


def triage(tickets: DataFrame, labels: DataFrame, orders: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Every ticket after a run: labels, order, retrieved entry ids, decision, awaiting_review.

    `labels`: ticket_id, category, category_confidence, urgency, urgency_confidence. `hits`: query_id
    (a ticket id), entry_id, rank; at most k rows per ticket. A ticket that cannot be processed is
    escalated with the reason instead of stopping the batch.
    """
    base = tickets.select("tenant_id", "ticket_id", "order_id", "subject", "body").withColumn("text", ticket_text())
    out = (
        with_order(with_rules(base), orders)
        .withColumns({"order_result": F.col("result"), "order_amount": F.col("amount").cast("double")})
        .join(labels, "ticket_id", "left")
    )
    if hits is not None:
        found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry_id"))).alias("h"))
        found = found.select(F.col("query_id").alias("ticket_id"), F.transform("h", lambda x: x["entry_id"]).alias("entries"))
        out = out.join(found, "ticket_id", "left")
    else:
        out = out.withColumn("entries", F.lit(None).cast("array<bigint>"))
    problem = F.when(F.coalesce("subject", F.lit("")) == "", "no subject").when(F.coalesce("body", F.lit("")) == "", "no body").when(
        F.col("category").isNull() | F.col("urgency").isNull(), "no label"
    )
    decided = with_decision(out).withColumn("error", problem)
    failed = F.col("error").isNotNull()
    reason = F.concat(F.lit(FAILED.split("{0}")[0]), "error", F.lit(FAILED.split("{0}")[1]))
    return decided.select(
        "tenant_id", "ticket_id", "category", "urgency", "weak_label", "order_result", "entries",
        F.lit("awaiting_review").alias("status"),
        F.when(failed, F.lit(True)).otherwise(F.col("needs_escalation")).alias("needs_escalation"),
        F.when(failed, reason).otherwise(F.col("escalation_reason")).alias("escalation_reason"),
    )


def grounded_prompts(tickets: DataFrame, orders: DataFrame, hits: DataFrame, entries: DataFrame) -> DataFrame:
    """One text per ticket for an outside generator: masked message, order lines, retrieved entries.

    The internal order id is left out. Each ticket has at most k entries, so the collected list is small.
    """
    o = orders.select(
        "tenant_id", "order_id", "status", "tracking_number", F.col("amount").cast("double").alias("amount"),
        "expected_delivery", "item_name", "order_date",
    )
    fields = ("status", "tracking_number", "amount", "expected_delivery", "item_name", "order_date")
    shown = F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("None"))) for f in fields])
    entry = F.format_string('<entry title="%s" similarity="%.2f">\n%s\n</entry>', "title", "similarity", "content")
    found = (
        hits.join(entries.select("entry_id", "title", "content"), "entry_id")
        .groupBy(F.col("query_id").alias("ticket_id"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("line")))).alias("h"))
        .select("ticket_id", F.array_join(F.transform("h", lambda x: x["line"]), "\n").alias("lines"))
    )
    asked = tickets.select("tenant_id", "ticket_id", "order_id", "subject", "body")
    joined = left_join_nullable(asked, o, ["tenant_id", "order_id"], "order_id", by="ticket_id").join(found, "ticket_id", "left")
    prompt = F.concat(
        F.lit("<customer_message>\nSubject: "), mask_contact("subject"), F.lit("\n\n"), mask_contact("body"),
        F.lit("\n</customer_message>\n\n<order>\n"),
        F.when(F.col("order_date").isNull(), "No order is linked to this ticket.").otherwise(shown),
        F.lit("\n</order>\n\n<knowledge_base>\n"),
        F.coalesce("lines", F.lit("No knowledge-base entries were found.")),
        F.lit("\n</knowledge_base>\n\nWrite the reply to this customer."),
    )
    return joined.select("tenant_id", "ticket_id", prompt.alias("prompt"))
