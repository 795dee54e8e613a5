"""Registered ticket, reference, review and run queries."""

from datetime import date

from pyspark.sql import functions as F

from ..functions import text
from ..operators import runs as r, tickets as k
from ..operators.scale import newest
from .registry import query
from .text import stripped

micros = lambda c, name=None: F.unix_micros(c).alias(name or c)
ORDER_DAY = date(1998, 6, 1)


@query("tickets_filtered", """
SELECT ticket_id, tenant_id, subject, epoch_us(created_at) AS created_us FROM fx_tickets
WHERE status = 'awaiting_review' AND category = 'refund_request' AND urgency = 'high'""")
def _(t):
    out = k.filtered(t.tickets, status="awaiting_review", category="refund_request", urgency="high")
    return out.select("ticket_id", "tenant_id", "subject", micros("created_at", "created_us"))


@query("tenant_scoped", """
SELECT order_id, tenant_id, status, CAST(amount AS DOUBLE) AS amount FROM fx_orders WHERE tenant_id = 2""")
def _(t):
    own = k.scoped(t.orders, 2).unionByName(k.scoped(t.orders, None))
    return own.select("order_id", "tenant_id", "status", F.col("amount").cast("double").alias("amount"))


@query("customer_search", """
SELECT customer_id, name, email FROM fx_customers
WHERE contains(lower(name), lower('Building.1')) OR contains(lower(email), lower('Building.1')) ORDER BY name, email, customer_id LIMIT 50""")
def _(t):
    return k.customer_search(t.customers, "Building.1", 50).select("customer_id", "name", "email")


@query("effective_labels", """
SELECT ticket_id, coalesce(corrected_category, category) AS effective_category, coalesce(corrected_urgency, urgency) AS effective_urgency FROM fx_tickets""")
def _(t):
    return k.effective_labels(t.tickets).select("ticket_id", "effective_category", "effective_urgency")


@query("corrected_tickets", """
SELECT ticket_id, tenant_id, corrected_category, corrected_urgency, corrected_by FROM fx_tickets
WHERE corrected_category IS NOT NULL OR corrected_urgency IS NOT NULL""")
def _(t):
    return k.corrected(t.tickets).select("ticket_id", "tenant_id", "corrected_category", "corrected_urgency", "corrected_by")


def _documents(t):
    status = F.expr("CASE lang WHEN 'fr' THEN 'processing' WHEN 'de' THEN 'failed' ELSE 'ready' END")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("document_id") * 60)
    return t.documents.withColumn("status", status).withColumn("created_at", at)


_DOCUMENTS = """docs AS (SELECT *, CASE lang WHEN 'fr' THEN 'processing' WHEN 'de' THEN 'failed' ELSE 'ready' END AS status,
  (1704067200 + document_id * 60) * 1000000 AS created_us FROM fx_documents)"""


@query("unfinished_work", f"""
WITH {_DOCUMENTS}
SELECT 'ticket' AS kind, ticket_id AS id, tenant_id, epoch_us(created_at) AS created_us FROM fx_tickets WHERE status IN ('new', 'in_progress')
UNION ALL SELECT 'document', document_id, tenant_id, created_us FROM docs WHERE status = 'processing'""")
def _(t):
    return k.unfinished_work(t.tickets, _documents(t)).select("kind", "id", "tenant_id", micros("created_at", "created_us"))


_INTAKE = f"""intake AS (SELECT request_id, tenant_id, trim(name) AS name, lower(trim(email)) AS email, trim(subject) AS subject,
  {stripped('message')} AS body,"""+r"""
  CASE WHEN NOT length(name) BETWEEN 1 AND 100 THEN 'name'
    WHEN NOT (length(email) BETWEEN 3 AND 320 AND regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')) THEN 'email'
    WHEN NOT length(subject) BETWEEN 1 AND 200 THEN 'subject' WHEN NOT length(message) BETWEEN 10 AND 5000 THEN 'message'
    WHEN website <> '' THEN 'honeypot' ELSE 'accepted' END AS verdict FROM fx_requests)"""


@query("contact_intake_clean", f"WITH {_INTAKE} SELECT * EXCLUDE (body), length(body) AS body_length FROM intake")
def _(t):
    out = k.contact_intake(t.requests)
    return out.select("request_id", "tenant_id", "name", "email", "subject", F.length("body").cast("bigint").alias("body_length"), "verdict")


@query("customer_upsert", f"""
WITH {_INTAKE}, fresh AS (SELECT tenant_id, email, min_by(name, request_id) AS name FROM intake WHERE verdict = 'accepted' GROUP BY ALL)
SELECT customer_id, tenant_id, name, email, false AS is_new FROM fx_customers
UNION ALL SELECT NULL, tenant_id, name, email, true FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM fx_customers c WHERE c.tenant_id = f.tenant_id AND c.email = f.email)""")
def _(t):
    return k.customer_upsert(t.customers, k.contact_intake(t.requests).filter("verdict = 'accepted'"))


@query("constraint_violations", """
SELECT 'ticket status value' AS rule, count(*) AS n FROM fx_tickets WHERE status NOT IN ('new', 'in_progress', 'awaiting_review', 'resolved')
UNION ALL SELECT 'ticket category value', count(*) FROM fx_tickets WHERE category NOT IN ('order_status', 'refund_request', 'damaged_item', 'delivery_delay', 'product_question', 'cancellation')
UNION ALL SELECT 'ticket urgency value', count(*) FROM fx_tickets WHERE urgency NOT IN ('low', 'medium', 'high')
UNION ALL SELECT 'ticket channel value', count(*) FROM fx_tickets WHERE channel NOT IN ('staff', 'contact_form')
UNION ALL SELECT 'ticket corrected_category value', count(*) FROM fx_tickets WHERE corrected_category NOT IN ('order_status', 'refund_request', 'damaged_item', 'delivery_delay', 'product_question', 'cancellation')
UNION ALL SELECT 'ticket corrected_urgency value', count(*) FROM fx_tickets WHERE corrected_urgency NOT IN ('low', 'medium', 'high')
UNION ALL SELECT 'customer e-mail unique per tenant', count(*) FROM (SELECT 1 FROM fx_customers GROUP BY tenant_id, email HAVING count(*) > 1)
UNION ALL SELECT 'section position unique per document', count(*) FROM (SELECT 1 FROM fx_sections GROUP BY document_id, position HAVING count(*) > 1)""")
def _(t):
    return k.constraint_violations(t.tickets, t.customers, t.sections)


def _correction_requests(t):
    label = F.expr("CASE ticket_id % 3 WHEN 0 THEN 'order_status' WHEN 1 THEN 'refund_request' ELSE NULL END")
    return t.tickets.select(
        "tenant_id", "ticket_id", label.alias("new_category"), F.expr("CASE ticket_id % 4 WHEN 0 THEN 'high' ELSE 'low' END").alias("new_urgency"),
        F.lit("r1").alias("reviewer_id"), F.col("created_at").alias("at"),
    )


@query("correction_nullif", """
WITH q AS (SELECT *, CASE ticket_id % 3 WHEN 0 THEN 'order_status' WHEN 1 THEN 'refund_request' END AS nc,
  CASE ticket_id % 4 WHEN 0 THEN 'high' ELSE 'low' END AS nu, category IS NOT NULL AND urgency IS NOT NULL AS ok FROM fx_tickets),
s AS (SELECT *, CASE WHEN ok THEN nullif(nc, category) END AS stored_category, CASE WHEN ok THEN nullif(nu, urgency) END AS stored_urgency FROM q)
SELECT tenant_id, ticket_id, CASE WHEN ok THEN 'stored' ELSE 'not triaged' END AS outcome, stored_category, stored_urgency,
  CASE WHEN stored_category IS NOT NULL OR stored_urgency IS NOT NULL THEN 'r1' END AS corrected_by,
  CASE WHEN stored_category IS NOT NULL OR stored_urgency IS NOT NULL THEN epoch_us(created_at) END AS corrected_us FROM s""")
def _(t):
    out = k.correction_nullif(_correction_requests(t), t.tickets)
    return out.select("tenant_id", "ticket_id", "outcome", "stored_category", "stored_urgency", "corrected_by", micros("corrected_at", "corrected_us"))


@query("order_consistency", f"""
WITH o AS (SELECT *, tracking_number IS NOT NULL AS tracked, CAST(expected_delivery AS DATE) AS due FROM fx_orders)
SELECT tenant_id, order_id, status, 'tracking before dispatch' AS rule FROM o WHERE status IN ('processing', 'cancelled') AND tracked
UNION ALL SELECT tenant_id, order_id, status, 'no tracking after dispatch' FROM o WHERE status IN ('shipped', 'delivered', 'delayed') AND NOT tracked
UNION ALL SELECT tenant_id, order_id, status, 'delivery date on a cancelled order' FROM o WHERE status = 'cancelled' AND due IS NOT NULL
UNION ALL SELECT tenant_id, order_id, status, 'no delivery date' FROM o WHERE status <> 'cancelled' AND due IS NULL
UNION ALL SELECT tenant_id, order_id, status, 'open order past its delivery date' FROM o WHERE status IN ('processing', 'shipped') AND due <= DATE '{ORDER_DAY}'
UNION ALL SELECT tenant_id, order_id, status, 'delivery date not reached' FROM o WHERE status IN ('delivered', 'delayed') AND due >= DATE '{ORDER_DAY}'""")
def _(t):
    return k.order_inconsistencies(t.orders, ORDER_DAY)


@query("slug_check", """
SELECT tenant_id, slug, regexp_matches(slug, '^[a-z0-9](?:[a-z0-9-]{0,38}[a-z0-9])?$') AS ok FROM fx_tenants""")
def _(t):
    return t.tenants.select("tenant_id", "slug", k.slug_ok(F.col("slug")).alias("ok"))


@query("ticket_order_lookup", """
SELECT t.tenant_id, t.ticket_id, t.order_id, o.status AS order_status, o.tracking_number, CAST(o.amount AS DOUBLE) AS amount, o.item_name,
  CASE WHEN o.order_id IS NULL THEN 'no order found' ELSE 'found' END AS result
FROM fx_tickets t LEFT JOIN fx_orders o ON o.tenant_id = t.tenant_id AND o.order_id = t.order_id WHERE t.order_id IS NOT NULL""")
def _(t):
    return k.ticket_order_lookup(t.tickets, t.orders).withColumn("amount", F.col("amount").cast("double"))


@query("invalid_ticket_refs", """
SELECT * FROM (SELECT t.ticket_id, t.tenant_id, CASE WHEN c.customer_id IS NULL THEN 'customer not found'
  WHEN t.order_id IS NOT NULL AND o.order_id IS NULL THEN 'order not found' WHEN o.customer_id <> t.customer_id THEN 'order of another customer' END AS reason
FROM fx_tickets t LEFT JOIN fx_customers c ON c.tenant_id = t.tenant_id AND c.customer_id = t.customer_id
LEFT JOIN fx_orders o ON o.tenant_id = t.tenant_id AND o.order_id = t.order_id) WHERE reason IS NOT NULL""")
def _(t):
    return k.invalid_refs(t.tickets, t.customers, t.orders)


@query("cross_tenant_refs", """
SELECT t.ticket_id, t.customer_id, t.tenant_id, c.tenant_id AS parent_tenant FROM fx_tickets t JOIN fx_customers c USING (customer_id) WHERE t.tenant_id <> c.tenant_id""")
def _(t):
    return k.cross_tenant_refs(t.tickets, "ticket_id", t.customers, "customer_id")


@query("ticket_detail", """
SELECT t.tenant_id, t.ticket_id, 'order' AS kind, 1 AS position, o.order_id AS item_id, o.status AS text FROM fx_tickets t JOIN fx_orders o ON o.tenant_id = t.tenant_id AND o.order_id = t.order_id
UNION ALL SELECT tenant_id, ticket_id, 'draft', row_number() OVER (PARTITION BY ticket_id ORDER BY created_at, draft_id), draft_id, coalesce(edited_text, draft_text) FROM fx_drafts
UNION ALL SELECT tenant_id, ticket_id, 'log', row_number() OVER (PARTITION BY ticket_id ORDER BY created_at, log_id), log_id, agent_name FROM fx_agent_logs""")
def _(t):
    return k.ticket_detail(t.tickets, t.orders, t.drafts, t.agent_logs)


@query("customer_orders", """
SELECT o.tenant_id, o.customer_id, o.order_id, CAST(o.order_date AS VARCHAR) AS order_date FROM fx_orders o JOIN fx_customers c USING (tenant_id, customer_id)""")
def _(t):
    return k.customer_orders(t.customers, t.orders).select("tenant_id", "customer_id", "order_id", F.col("order_date").cast("string").alias("order_date"))


@query("delete_cascade", """
SELECT 'tickets' AS table_name, tenant_id, count(*) AS n FROM fx_tickets WHERE tenant_id IN (SELECT tenant_id FROM fx_tenants WHERE slug LIKE 'a%') GROUP BY tenant_id
UNION ALL SELECT 'drafts', tenant_id, count(*) FROM fx_drafts WHERE tenant_id IN (SELECT tenant_id FROM fx_tenants WHERE slug LIKE 'a%') GROUP BY tenant_id
UNION ALL SELECT 'orders', tenant_id, count(*) FROM fx_orders WHERE tenant_id IN (SELECT tenant_id FROM fx_tenants WHERE slug LIKE 'a%') GROUP BY tenant_id
UNION ALL SELECT 'customers', tenant_id, count(*) FROM fx_customers WHERE tenant_id IN (SELECT tenant_id FROM fx_tenants WHERE slug LIKE 'a%') GROUP BY tenant_id
UNION ALL SELECT 'sections', tenant_id, count(*) FROM fx_sections WHERE tenant_id IN (SELECT tenant_id FROM fx_tenants WHERE slug LIKE 'a%') GROUP BY tenant_id""")
def _(t):
    tables = {"tickets": t.tickets, "drafts": t.drafts, "orders": t.orders, "customers": t.customers, "sections": t.sections}
    return k.delete_tenant_counts(tables, t.tenants.filter(F.col("slug").startswith("a")))


@query("pending_draft", """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, draft_id DESC) AS rn FROM fx_drafts)
SELECT t.tenant_id, t.ticket_id, CASE WHEN t.status = 'awaiting_review' AND d.approved IS NULL THEN d.draft_id END AS draft_id,
  CASE WHEN t.status <> 'awaiting_review' THEN concat('ticket is ', t.status) WHEN d.draft_id IS NULL OR d.approved IS NOT NULL THEN 'no draft awaiting review' END AS conflict
FROM fx_tickets t LEFT JOIN d ON d.ticket_id = t.ticket_id AND d.rn = 1""")
def _(t):
    return k.pending_draft(t.tickets, t.drafts)


@query("review_queue", """
SELECT tenant_id, ticket_id, needs_escalation, coalesce(corrected_urgency, urgency) AS effective_urgency, epoch_us(created_at) AS created_us,
  CASE coalesce(corrected_urgency, urgency) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS urgency_rank
FROM fx_tickets WHERE status = 'awaiting_review'""")
def _(t):
    return k.review_queue(t.tickets).select("tenant_id", "ticket_id", "needs_escalation", "effective_urgency", micros("created_at", "created_us"), "urgency_rank")


@query("newest_first_lists", f"""
WITH {_DOCUMENTS}
SELECT 'ticket' AS kind, ticket_id AS id, epoch_us(created_at) AS created_us FROM fx_tickets
UNION ALL SELECT 'document', document_id, created_us FROM docs""")
def _(t):
    a = t.tickets.select(F.lit("ticket").alias("kind"), F.col("ticket_id").alias("id"), "created_at")
    b = _documents(t).select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), "created_at")
    return k.newest_first(a.unionByName(b), "id").select("kind", "id", micros("created_at", "created_us"))


@query("member_list", "SELECT tenant_id, user_id, name, is_active FROM fx_users")
def _(t):
    return k.members(t.users).select("tenant_id", "user_id", "name", "is_active")


# --- actions: every ticket is approved (or edited), some are rerun before or after, some corrected
_ACTIONS = [
    ("approve", 2, "ticket_id % 5 <> 0"), ("edit", 3, "ticket_id % 3 = 0"), ("rerun", 1, "ticket_id % 7 = 0"),
    ("rerun", 4, "ticket_id % 4 = 1"), ("correct", 5, "ticket_id % 2 = 0"), ("approve", 6, "true"),
]


def _actions(t):
    rows = F.array_compact(
        F.array(*[F.when(F.expr(cond), F.struct(F.lit(a).alias("action"), F.lit(i).alias("step"))) for a, i, cond in _ACTIONS])
    )
    return _correction_requests(t).withColumn("x", F.explode(rows)).select(
        "tenant_id", "ticket_id", "new_category", "new_urgency", "reviewer_id", "at",
        F.concat(F.lit("text of "), F.col("x.action")).alias("text"),
        F.col("x.action").alias("action"), (F.col("ticket_id") * 10 + F.col("x.step")).alias("action_id"),
    )


_ACTIONS_SQL = " UNION ALL ".join(
    f"SELECT tenant_id, ticket_id, '{a}' AS action, ticket_id * 10 + {i} AS action_id FROM fx_tickets WHERE {c}" for a, i, c in _ACTIONS
)
# state per ticket walked action by action: (status, approved once, category fix, urgency fix)
_FOLD = f"""
WITH RECURSIVE acts AS ({_ACTIONS_SQL}), ordered AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY action_id) AS rn FROM acts),
d AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, draft_id DESC) AS rn FROM fx_drafts),
base AS (SELECT t.*, d.draft_id, d.approved, CASE t.ticket_id % 3 WHEN 0 THEN 'order_status' WHEN 1 THEN 'refund_request' END AS nc,
  CASE t.ticket_id % 4 WHEN 0 THEN 'high' ELSE 'low' END AS nu FROM fx_tickets t LEFT JOIN d ON d.ticket_id = t.ticket_id AND d.rn = 1),
walk AS (
  SELECT ticket_id, 0 AS rn, status, CAST(NULL AS BIGINT) AS approved_draft_id, corrected_category, corrected_urgency, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS action_id, CAST(NULL AS VARCHAR) AS verdict FROM base
  UNION ALL
  SELECT w.ticket_id, w.rn + 1,
    CASE WHEN o.action IN ('approve', 'edit') AND w.status = 'awaiting_review' AND b.draft_id IS NOT NULL AND b.approved IS NULL THEN 'resolved'
      WHEN o.action = 'rerun' AND w.status <> 'in_progress' THEN 'in_progress' ELSE w.status END,
    CASE WHEN o.action IN ('approve', 'edit') AND w.status = 'awaiting_review' AND b.draft_id IS NOT NULL AND b.approved IS NULL THEN b.draft_id ELSE w.approved_draft_id END,
    CASE WHEN o.action = 'correct' AND b.category IS NOT NULL AND b.urgency IS NOT NULL THEN nullif(b.nc, b.category) ELSE w.corrected_category END,
    CASE WHEN o.action = 'correct' AND b.category IS NOT NULL AND b.urgency IS NOT NULL THEN nullif(b.nu, b.urgency) ELSE w.corrected_urgency END,
    o.action, o.action_id,
    CASE WHEN o.action IN ('approve', 'edit') THEN CASE WHEN w.status = 'awaiting_review' AND b.draft_id IS NOT NULL AND b.approved IS NULL THEN 'applied' ELSE 'conflict' END
      WHEN o.action = 'rerun' THEN CASE WHEN w.status <> 'in_progress' THEN 'applied' ELSE 'conflict' END
      ELSE CASE WHEN b.category IS NOT NULL AND b.urgency IS NOT NULL THEN 'applied' ELSE 'not triaged' END END
  FROM walk w JOIN ordered o ON o.ticket_id = w.ticket_id AND o.rn = w.rn + 1 JOIN base b ON b.ticket_id = w.ticket_id)
"""


@query("apply_review_actions", _FOLD + """
SELECT ticket_id, status, approved_draft_id, corrected_category, corrected_urgency,
  (SELECT CASE WHEN y.action = 'edit' THEN 'text of edit' END FROM walk y WHERE y.ticket_id = walk.ticket_id AND y.action IN ('approve', 'edit') AND y.verdict = 'applied') AS edited_text FROM walk
WHERE rn = (SELECT max(x.rn) FROM walk x WHERE x.ticket_id = walk.ticket_id)""")
def _(t):
    state, _verdicts = k.apply_review_actions(t.tickets, t.drafts, _actions(t))
    return state.select("ticket_id", "status", "approved_draft_id", "corrected_category", "corrected_urgency", "edited_text")


@query("review_action_verdicts", _FOLD + "SELECT action_id, ticket_id, action, verdict FROM walk WHERE rn > 0")
def _(t):
    _state, verdicts = k.apply_review_actions(t.tickets, t.drafts, _actions(t))
    return verdicts.select("action_id", "ticket_id", "action", "verdict")


# --- runs
_RUNS = """numbered AS (SELECT *, sum(CASE WHEN agent_name = 'triage' OR first THEN 1 ELSE 0 END) OVER (PARTITION BY ticket_id ORDER BY created_at, log_id ROWS UNBOUNDED PRECEDING) AS run_no
  FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at, log_id) = 1 AS first FROM fx_agent_logs)),
runs AS (SELECT ticket_id, CAST(run_no AS BIGINT) AS run_no, count(*) AS logs, bool_or(agent_name = 'escalation' OR output LIKE '{"error"%') AS finished,
  bool_or(output LIKE '{"error"%') AS failed, epoch_us(min(created_at)) AS started_us, list(DISTINCT agent_name) AS steps FROM numbered GROUP BY ALL)"""


@query("agent_runs", f"WITH {_RUNS} SELECT ticket_id, run_no, logs, finished, failed, started_us FROM runs")
def _(t):
    return r.agent_runs(t.agent_logs).select("ticket_id", "run_no", "logs", "finished", "failed", micros("started_at", "started_us"))


@query("current_run", f"""
WITH {_RUNS}, last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY run_no DESC) = 1),
e AS (SELECT t.tenant_id, t.ticket_id, l.*  EXCLUDE (ticket_id), l.run_no IS NULL OR (t.status IN ('new', 'in_progress') AND l.finished) AS empty FROM fx_tickets t LEFT JOIN last l ON l.ticket_id = t.ticket_id)
SELECT tenant_id, ticket_id, CASE WHEN empty THEN coalesce(run_no, 0) + 1 ELSE run_no END AS run_no, CASE WHEN empty THEN 0 ELSE logs END AS logs,
  CASE WHEN empty THEN false ELSE finished END AS finished, CASE WHEN empty THEN false ELSE failed END AS failed FROM e""")
def _(t):
    return r.current_run(t.tickets, r.agent_runs(t.agent_logs))


@query("run_missing_steps", f"""
WITH {_RUNS}, s AS (SELECT unnest(['triage', 'knowledge', 'order_lookup', 'draft', 'escalation']) AS step)
SELECT r.ticket_id, r.run_no, s.step FROM runs r JOIN fx_tickets t ON t.ticket_id = r.ticket_id CROSS JOIN s
WHERE NOT list_contains(r.steps, s.step) AND (s.step <> 'order_lookup' OR t.order_id IS NOT NULL)""")
def _(t):
    return r.missing_steps(t.tickets, r.agent_runs(t.agent_logs))


@query("trace_in_order", "SELECT ticket_id, log_id, agent_name, epoch_us(created_at) AS created_us FROM fx_agent_logs")
def _(t):
    return r.trace_in_order(t.agent_logs).select("ticket_id", "log_id", "agent_name", micros("created_at", "created_us"))


_FIELDS = """fields AS (SELECT log_id, ticket_id, agent_name, json_extract_string(output, '$.category.label') AS category,
  CAST(json_extract(output, '$.category.confidence') AS DOUBLE) AS category_confidence, json_extract_string(output, '$.urgency.label') AS urgency,
  CAST(json_extract(output, '$.urgency.confidence') AS DOUBLE) AS urgency_confidence,
  CAST(coalesce(json_array_length(output, '$.retrieved'), 0) AS BIGINT) AS hits,
  CAST(json_extract(output, '$.decision.needs_escalation') AS BOOLEAN) AS needs_escalation,
  json_extract_string(output, '$.result.item_name') AS item_name, json_extract_string(output, '$.result.status') AS order_status,
  json_extract_string(output, '$.mode') AS mode, json_extract_string(output, '$.model') AS model, json_extract_string(output, '$.error') AS error FROM fx_agent_logs)"""


@query("log_json_fields", f"WITH {_FIELDS} SELECT * FROM fields")
def _(t):
    return r.log_fields(t.agent_logs).withColumn("hits", F.col("hits").cast("bigint"))


@query("trace_headline", f"""
WITH {_FIELDS}
SELECT log_id, ticket_id, agent_name, CASE agent_name
  WHEN 'triage' THEN coalesce(upper(left(replace(category, '_', ' '), 1)) || substr(replace(category, '_', ' '), 2) || ', ' || urgency || ' urgency', 'Classified')
  WHEN 'knowledge' THEN 'Found ' || hits || CASE WHEN hits = 1 THEN ' knowledge-base entry' ELSE ' knowledge-base entries' END
  WHEN 'order_lookup' THEN coalesce(item_name || ', ' || order_status, 'No order found')
  WHEN 'draft' THEN CASE WHEN mode = 'offline' THEN 'Wrote a placeholder draft (no LLM configured)' ELSE 'Drafted a reply with ' || coalesce(model, 'the LLM') END
  ELSE CASE WHEN needs_escalation THEN 'Flagged for escalation' ELSE 'No escalation needed' END END AS headline FROM fields""")
def _(t):
    return r.trace_headline(r.log_fields(t.agent_logs))


@query("latest_predictions", """
SELECT ticket_id, model_name, model_version, prediction, confidence FROM fx_predictions
QUALIFY row_number() OVER (PARTITION BY ticket_id, model_name ORDER BY created_at DESC, model_version DESC) = 1""")
def _(t):
    return newest(t.predictions, ["ticket_id", "model_name"], ["created_at", "model_version"], ["model_version", "prediction", "confidence"])


@query("receipt_ref", "SELECT ticket_id, upper(left(md5(CAST(ticket_id AS VARCHAR)), 8)) AS reference FROM fx_tickets")
def _(t):
    return t.tickets.select("ticket_id", text.receipt_ref(F.md5(F.col("ticket_id").cast("string").cast("binary"))).alias("reference"))


@query("ticket_text", "SELECT ticket_id, subject || chr(10) || body AS text FROM fx_tickets")
def _(t):
    return t.tickets.select("ticket_id", text.ticket_text().alias("text"))
