"""Ticket lists, checks, joins, review queue and review actions, for all tenants at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..schema import CATEGORIES, CHANNELS, TICKET_STATUSES, URGENCIES
from .scale import left_join_nullable, newest, running_sum

# Accepted address and slug patterns, field lengths of the contact form
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
SLUG = r"^[a-z0-9](?:[a-z0-9-]{0,38}[a-z0-9])?$"
NAME_LENGTH, EMAIL_LENGTH, SUBJECT_LENGTH, MESSAGE_LENGTH = (1, 100), (3, 320), (1, 200), (10, 5000)


# --- filters and lists -------------------------------------------------------------------


def scoped(df: DataFrame, tenant_id: int | None) -> DataFrame:
    """Rows of one tenant; without a tenant nothing matches."""
    return df.filter(F.lit(False)) if tenant_id is None else df.filter(F.col("tenant_id") == tenant_id)


def filtered(tickets: DataFrame, status: str | None = None, category: str | None = None, urgency: str | None = None) -> DataFrame:
    """Tickets matching every given value, newest first."""
    for column, value in (("status", status), ("category", category), ("urgency", urgency)):
        if value is not None:
            tickets = tickets.filter(F.col(column) == value)
    return newest_first(tickets, "ticket_id")


def newest_first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc(key))


def members(users: DataFrame) -> DataFrame:
    return users.orderBy("tenant_id", F.desc("is_active"), "name", "user_id")


def customer_search(customers: DataFrame, text: str | None, limit: int) -> DataFrame:
    """Customers whose name or e-mail contains `text` in any case; % and _ are ordinary characters."""
    if text:
        needle = F.lower(F.lit(text))
        customers = customers.filter(F.contains(F.lower("name"), needle) | F.contains(F.lower("email"), needle))
    return customers.orderBy("name", "email", "customer_id").limit(limit)


def effective_labels(tickets: DataFrame) -> DataFrame:
    return tickets.withColumns(
        {
            "effective_category": F.coalesce("corrected_category", "category"),
            "effective_urgency": F.coalesce("corrected_urgency", "urgency"),
        }
    )


def corrected(tickets: DataFrame) -> DataFrame:
    return tickets.filter(F.coalesce("corrected_category", "corrected_urgency").isNotNull())


def unfinished_work(tickets: DataFrame, documents: DataFrame) -> DataFrame:
    """Tickets still with the agents and documents still processing, oldest first, all tenants."""
    waiting = tickets.filter(F.col("status").isin("new", "in_progress")).select(
        F.lit("ticket").alias("kind"), F.col("ticket_id").alias("id"), "tenant_id", "created_at"
    )
    processing = documents.filter(F.col("status") == "processing").select(
        F.lit("document").alias("kind"), F.col("document_id").alias("id"), "tenant_id", "created_at"
    )
    return waiting.unionByName(processing).orderBy("created_at", "kind", "id")


def slug_ok(slug: Column) -> Column:
    return slug.rlike(SLUG)


# --- intake ------------------------------------------------------------------------------


def contact_intake(requests: DataFrame) -> DataFrame:
    """Cleaned contact-form requests with a verdict: accepted, honeypot, or the field at fault.

    Lengths and the address pattern are checked on what was sent, so a blank inside or around an
    address refuses it; the other fields are trimmed afterwards.
    """
    between = lambda c, bounds: F.length(c).between(*bounds)
    verdict = (
        F.when(~between("name", NAME_LENGTH), "name")
        .when(~(between("email", EMAIL_LENGTH) & F.col("email").rlike("(?U)" + EMAIL)), "email")
        .when(~between("subject", SUBJECT_LENGTH), "subject")
        .when(~between("message", MESSAGE_LENGTH), "message")
        .when(F.coalesce("website", F.lit("")) != "", "honeypot")
        .otherwise("accepted")
    )
    return requests.withColumn("verdict", verdict).withColumns(
        {
            "name": strip("name"),
            "email": F.lower(strip("email")),
            "subject": strip("subject"),
            "body": strip("message"),
        }
    )


def customer_upsert(customers: DataFrame, requests: DataFrame) -> DataFrame:
    """Existing customers plus one new row per unseen (tenant, e-mail) of the cleaned requests.

    The first request of an address names the customer. `customer_id` of a new row is null until
    the store assigns one.
    """
    first = requests.groupBy("tenant_id", "email").agg(F.min_by("name", "request_id").alias("name"))
    fresh = first.join(customers.select("tenant_id", "email").distinct(), ["tenant_id", "email"], "left_anti")
    return customers.select("customer_id", "tenant_id", "name", "email", F.lit(False).alias("is_new")).unionByName(
        fresh.select(F.lit(None).cast("bigint").alias("customer_id"), "tenant_id", "name", "email", F.lit(True).alias("is_new"))
    )


# --- references and data quality ---------------------------------------------------------


def with_order(tickets: DataFrame, orders: DataFrame) -> DataFrame:
    """Tickets with the facts of their order in the same tenant, and what the lookup found (null
    when no order is linked). One join, so it also works on a stream of tickets."""
    facts = orders.select(
        "tenant_id", "order_id", F.col("status").alias("order_status"), "tracking_number", "amount", "item_name"
    )
    result = F.when(F.col("order_id").isNotNull(), F.when(F.col("order_status").isNull(), "no order found").otherwise("found"))
    return left_join_nullable(tickets, facts, ["tenant_id", "order_id"], "order_id", by="ticket_id").withColumn("result", result)


def ticket_order_lookup(tickets: DataFrame, orders: DataFrame) -> DataFrame:
    """Order facts of every ticket that links one; an order of another tenant is not found."""
    linked = tickets.filter(F.col("order_id").isNotNull()).select("tenant_id", "ticket_id", "order_id")
    return with_order(linked, orders)


def invalid_refs(tickets: DataFrame, customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Tickets whose customer or order does not exist in their tenant, or belongs to someone else."""
    c = customers.select("tenant_id", "customer_id", F.lit(True).alias("has_customer"))
    o = orders.select("tenant_id", "order_id", F.col("customer_id").alias("order_owner"))
    reason = (
        F.when(F.col("has_customer").isNull(), F.lit("customer not found"))
        .when(F.col("order_id").isNotNull() & F.col("order_owner").isNull(), F.lit("order not found"))
        .when(F.col("order_owner") != F.col("customer_id"), F.lit("order of another customer"))
    )
    known = tickets.select("ticket_id", "tenant_id", "customer_id", "order_id").join(c, ["tenant_id", "customer_id"], "left")
    return (
        left_join_nullable(known, o, ["tenant_id", "order_id"], "order_id", by="ticket_id")
        .withColumn("reason", reason)
        .filter("reason IS NOT NULL")
        .select("ticket_id", "tenant_id", "reason")
    )


def cross_tenant_refs(children: DataFrame, child_key: str, parents: DataFrame, key: str) -> DataFrame:
    """Child rows pointing at a parent that lives in another tenant."""
    p = parents.select(key, F.col("tenant_id").alias("parent_tenant"))
    return (
        children.select(child_key, key, "tenant_id").join(p, key).filter(F.col("tenant_id") != F.col("parent_tenant"))
    )


def constraint_violations(tickets: DataFrame, customers: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per broken rule: rule name and number of offending rows (or duplicate keys)."""
    outside = lambda column, allowed: F.count_if(~F.col(column).isin(*allowed))
    rules = {
        "status": outside("status", TICKET_STATUSES),
        "category": outside("category", CATEGORIES),
        "urgency": outside("urgency", URGENCIES),
        "channel": outside("channel", CHANNELS),
        "corrected_category": outside("corrected_category", CATEGORIES),
        "corrected_urgency": outside("corrected_urgency", URGENCIES),
    }
    enum = tickets.agg(*[e.alias(name) for name, e in rules.items()]).select(
        F.inline(F.array(*[F.struct(F.lit(f"ticket {name} value").alias("rule"), F.col(name).alias("n")) for name in rules]))
    )
    repeated = lambda df, keys, rule: (
        df.groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.count_if(F.col("__n") > 1).alias("n")).select(F.lit(rule).alias("rule"), "n")
    )
    return enum.unionByName(repeated(customers, ["tenant_id", "email"], "customer e-mail unique per tenant")).unionByName(
        repeated(sections, ["document_id", "position"], "section position unique per document")
    )


def correction_nullif(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """Corrections as they are stored: a label equal to the model's becomes null, and who/when go
    with it; an untriaged ticket is rejected."""
    model = tickets.select("ticket_id", "tenant_id", "category", "urgency")
    joined = requests.join(model, ["tenant_id", "ticket_id"])
    triaged = F.col("category").isNotNull() & F.col("urgency").isNotNull()
    out = joined.withColumns(
        {
            "stored_category": F.when(triaged, F.nullif("new_category", "category")),
            "stored_urgency": F.when(triaged, F.nullif("new_urgency", "urgency")),
            "outcome": F.when(triaged, F.lit("stored")).otherwise(F.lit("not triaged")),
        }
    )
    any_left = F.coalesce("stored_category", "stored_urgency").isNotNull()
    return out.select(
        "tenant_id", "ticket_id", "outcome", "stored_category", "stored_urgency",
        F.when(any_left, F.col("reviewer_id")).alias("corrected_by"),
        F.when(any_left, F.col("at")).alias("corrected_at"),
    )


def order_inconsistencies(orders: DataFrame, today) -> DataFrame:
    """Orders whose status disagrees with tracking number or expected delivery, one row per rule."""
    status, tracked, due = F.col("status"), F.col("tracking_number").isNotNull(), F.col("expected_delivery")
    day = F.lit(today)
    rules = F.array_compact(
        F.array(
            F.when(status.isin("processing", "cancelled") & tracked, "tracking before dispatch"),
            F.when(status.isin("shipped", "delivered", "delayed") & ~tracked, "no tracking after dispatch"),
            F.when((status == "cancelled") & due.isNotNull(), "delivery date on a cancelled order"),
            F.when((status != "cancelled") & due.isNull(), "no delivery date"),
            F.when(status.isin("processing", "shipped") & (due <= day), "open order past its delivery date"),
            F.when(status.isin("delivered", "delayed") & (due >= day), "delivery date not reached"),
        )
    )
    return orders.select("tenant_id", "order_id", "status", F.explode(rules).alias("rule"))


# --- detail views ------------------------------------------------------------------------


def ticket_detail(tickets: DataFrame, orders: DataFrame, drafts: DataFrame, logs: DataFrame) -> DataFrame:
    """Every ticket with its order, drafts and logs as ordered rows: (ticket, kind, position, ...).

    Kept long instead of nested: a ticket with millions of log lines stays spread over tasks.
    Positions count per ticket in time order, numbered within hours first.
    """
    order = ticket_order_lookup(tickets, orders).filter("result = 'found'").select(
        "tenant_id", "ticket_id", F.lit("order").alias("kind"), F.lit(1).cast("bigint").alias("position"),
        F.col("order_id").alias("item_id"), F.col("order_status").alias("text"),
    )
    numbered = lambda df, key: running_sum(df, ["ticket_id"], ["created_at", key], F.date_trunc("hour", "created_at"), name="position")
    mine = tickets.select("tenant_id", "ticket_id")
    draft = numbered(drafts.join(mine, ["tenant_id", "ticket_id"], "left_semi"), "draft_id").select(
        "tenant_id", "ticket_id", F.lit("draft").alias("kind"), "position", F.col("draft_id").alias("item_id"),
        F.coalesce("edited_text", "draft_text").alias("text"),
    )
    log = numbered(logs.join(mine, ["tenant_id", "ticket_id"], "left_semi"), "log_id").select(
        "tenant_id", "ticket_id", F.lit("log").alias("kind"), "position", F.col("log_id").alias("item_id"),
        F.col("agent_name").alias("text"),
    )
    return order.unionByName(draft).unionByName(log)


def customer_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of known customers, newest first per customer."""
    known = customers.select("tenant_id", "customer_id")
    return orders.join(known, ["tenant_id", "customer_id"], "left_semi").orderBy(
        "tenant_id", "customer_id", F.desc("order_date"), F.desc("order_id")
    )


def delete_tenant_counts(tables: dict[str, DataFrame], tenants: DataFrame) -> DataFrame:
    """Rows that go per table when the given tenants are deleted."""
    gone = tenants.select("tenant_id")
    parts = [
        df.join(gone, "tenant_id", "left_semi").groupBy("tenant_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "tenant_id", "n")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- review ------------------------------------------------------------------------------


def urgency_rank(urgency: Column) -> Column:
    return F.when(urgency == "high", 0).when(urgency == "medium", 1).when(urgency == "low", 2).otherwise(3)


def review_queue(tickets: DataFrame) -> DataFrame:
    """Tickets awaiting review: escalated first (undecided last), most urgent, then oldest."""
    return (
        effective_labels(tickets.filter(F.col("status") == "awaiting_review"))
        .withColumn("urgency_rank", urgency_rank(F.col("effective_urgency")))
        .orderBy("tenant_id", F.desc_nulls_last("needs_escalation"), "urgency_rank", "created_at", "ticket_id")
    )


NO_PENDING = "no draft awaiting review"


def pending_draft(tickets: DataFrame, drafts: DataFrame) -> DataFrame:
    """The newest draft per ticket if it can be reviewed, else why not."""
    latest = newest(drafts, ["tenant_id", "ticket_id"], ["created_at", "draft_id"], ["draft_id", "approved"])
    waiting = F.col("status") == "awaiting_review"
    usable = waiting & F.col("draft_id").isNotNull() & F.col("approved").isNull()
    return (
        tickets.select("tenant_id", "ticket_id", "status")
        .join(latest, ["tenant_id", "ticket_id"], "left")
        .select(
            "tenant_id", "ticket_id",
            F.when(usable, F.col("draft_id")).alias("draft_id"),
            F.when(~waiting, F.concat(F.lit("ticket is "), "status")).when(~usable, F.lit(NO_PENDING)).alias("conflict"),
        )
    )


def apply_review_actions(tickets: DataFrame, drafts: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold review actions into ticket state; returns (tickets, verdict per action).

    Actions: approve, edit (approve with the column `text`), correct, rerun; ordered by (at, action_id). The
    newest draft is fixed for the batch and no new draft appears while it is folded, so each
    verdict follows from two facts that are plain aggregates per ticket: the first approval and
    the first rerun. A ticket resolved by its first valid approval accepts one later rerun; a
    ticket under way accepts neither approvals nor reruns. Corrections always count when the
    ticket is triaged, and the last one wins. No ticket's actions are folded in one task.
    """
    key = ["tenant_id", "ticket_id"]
    when = F.struct("at", "action_id")
    approving = F.col("action").isin("approve", "edit")
    if "text" not in actions.columns:
        actions = actions.withColumn("text", F.lit(None).cast("string"))
    first = actions.groupBy(*key).agg(
        F.min(F.when(approving, when)).alias("first_approve"),
        F.min_by(F.when(F.col("action") == "edit", F.col("text")), F.when(approving, when)).alias("first_text"),
        F.min(F.when(F.col("action") == "rerun", when)).alias("first_rerun"),
    )
    pending = pending_draft(tickets, drafts).select(*key, "draft_id", "conflict")
    state = (
        tickets.join(first, key, "left")
        .join(pending, key)
        # the approval holds unless a rerun took the ticket away before it
        .withColumn(
            "approval",
            F.when(
                F.col("draft_id").isNotNull() & (F.col("first_rerun").isNull() | (F.col("first_approve") < F.col("first_rerun"))),
                F.col("first_approve"),
            ),
        )
        .withColumn("rerun", F.when(F.col("status") != "in_progress", F.col("first_rerun")))
    )
    facts = state.select(*key, "draft_id", "conflict", "approval", "rerun", F.col("status").alias("before"), (F.col("category").isNotNull() & F.col("urgency").isNotNull()).alias("triaged"))
    verdict = (
        F.when(approving, F.when(when == F.col("approval"), "applied").otherwise("conflict"))
        .when(F.col("action") == "rerun", F.when(when == F.col("rerun"), "applied").otherwise("conflict"))
        .when(F.col("action") == "correct", F.when(F.col("triaged"), "applied").otherwise("not triaged"))
        .otherwise("unknown action")
    )
    judged = actions.join(facts, key, "left").withColumn(
        "verdict", F.when(F.col("before").isNull(), "ticket not found").otherwise(verdict)
    )
    last_correction = (
        judged.filter((F.col("action") == "correct") & (F.col("verdict") == "applied"))
        .groupBy(*key)
        .agg(F.max_by(F.struct("new_category", "new_urgency", "reviewer_id", "at"), when).alias("fix"))
    )
    status = (
        F.when(F.col("rerun").isNotNull(), "in_progress").when(F.col("approval").isNotNull(), "resolved").otherwise(F.col("status"))
    )
    folded = state.join(last_correction, key, "left").withColumn("new_status", status)
    fixed = F.col("fix").isNotNull()
    category = F.when(fixed, F.nullif(F.col("fix.new_category"), F.col("category"))).otherwise(F.col("corrected_category"))
    urgency = F.when(fixed, F.nullif(F.col("fix.new_urgency"), F.col("urgency"))).otherwise(F.col("corrected_urgency"))
    folded = folded.withColumns({"corrected_category": category, "corrected_urgency": urgency})
    kept = F.coalesce("corrected_category", "corrected_urgency").isNotNull()
    out = folded.select(
        *key,
        F.col("new_status").alias("status"),
        F.when(F.col("approval").isNotNull(), F.col("draft_id")).alias("approved_draft_id"),
        F.when(F.col("approval").isNotNull(), F.col("first_text")).alias("edited_text"),
        "corrected_category",
        "corrected_urgency",
        F.when(fixed, F.when(kept, F.col("fix.reviewer_id"))).otherwise(F.col("corrected_by")).alias("corrected_by"),
        F.when(fixed, F.when(kept, F.col("fix.at"))).otherwise(F.col("corrected_at")).alias("corrected_at"),
    )
    return out, judged.select("action_id", *key, "action", "verdict")
