"""Registered metric queries."""

from datetime import date

from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics as m
from ..schema import CATEGORIES, TICKET_STATUSES
from .registry import query

TODAY, DAYS = date(2024, 1, 30), 30
_CATEGORIES = ", ".join(f"'{c}'" for c in CATEGORIES)
_STATUSES = ", ".join(f"'{c}'" for c in TICKET_STATUSES)
_REVIEWED = """reviewed AS (SELECT t.tenant_id, t.ticket_id, t.category, d.edited_text IS NOT NULL AS edited,
  coalesce(t.needs_escalation, false) AS flagged, (epoch_us(d.reviewed_at) - epoch_us(t.created_at)) / 1e6 AS seconds
  FROM fx_drafts d JOIN fx_tickets t ON t.ticket_id = d.ticket_id AND t.tenant_id = d.tenant_id WHERE d.approved)"""


def reviewed(t):
    return m.reviewed_drafts(t.drafts, t.tickets)


@query("tickets_by_status", f"""
SELECT n.tenant_id, s.status, count(t.ticket_id) AS n FROM fx_tenants n CROSS JOIN (SELECT unnest([{_STATUSES}]) AS status) s
LEFT JOIN fx_tickets t ON t.tenant_id = n.tenant_id AND t.status = s.status GROUP BY ALL""")
def _(t):
    return m.tickets_by_status(t.tickets, t.tenants)


@query("tickets_by_category", f"""
SELECT n.tenant_id, s.category, count(t.ticket_id) AS n FROM fx_tenants n CROSS JOIN (SELECT unnest([{_CATEGORIES}]) AS category) s
LEFT JOIN fx_tickets t ON t.tenant_id = n.tenant_id AND t.category = s.category GROUP BY ALL""")
def _(t):
    return m.tickets_by_category(t.tickets, t.tenants)


@query("escalation_rate", """
SELECT n.tenant_id, count(t.needs_escalation) AS decided, count(*) FILTER (t.needs_escalation) AS escalated,
  count(*) FILTER (t.needs_escalation) / nullif(count(t.needs_escalation), 0) AS rate
FROM fx_tenants n LEFT JOIN fx_tickets t ON t.tenant_id = n.tenant_id GROUP BY n.tenant_id""")
def _(t):
    return m.escalation_rate(t.tickets, t.tenants)


@query("escalation_by_day", f"""
SELECT n.tenant_id, CAST(s.day AS VARCHAR) AS day, count(t.needs_escalation) AS processed, count(*) FILTER (t.needs_escalation) AS escalated,
  count(*) FILTER (t.needs_escalation) / nullif(count(t.needs_escalation), 0) AS rate
FROM fx_tenants n CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - {DAYS - 1}, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day) s
LEFT JOIN fx_tickets t ON t.tenant_id = n.tenant_id AND CAST(t.created_at AS DATE) = s.day GROUP BY ALL""")
def _(t):
    return m.escalation_by_day(t.tickets, t.tenants, TODAY, DAYS).withColumn("day", F.col("day").cast("string"))


@query("review_outcomes", f"""
WITH {_REVIEWED}
SELECT n.tenant_id, o.outcome, count(r.ticket_id) FILTER (r.flagged) AS escalated, count(r.ticket_id) FILTER (NOT r.flagged) AS not_escalated
FROM fx_tenants n CROSS JOIN (VALUES ('approved_as_is', false), ('edited', true)) o(outcome, edited)
LEFT JOIN reviewed r ON r.tenant_id = n.tenant_id AND r.edited = o.edited GROUP BY n.tenant_id, o.outcome""")
def _(t):
    return m.review_outcomes(reviewed(t), t.tenants)


@query("approval_rate", f"""
WITH {_REVIEWED}
SELECT n.tenant_id, count(r.ticket_id) AS reviewed, count(*) FILTER (NOT r.edited) AS as_is,
  count(*) FILTER (NOT r.edited) / nullif(count(r.ticket_id), 0) AS rate
FROM fx_tenants n LEFT JOIN reviewed r ON r.tenant_id = n.tenant_id GROUP BY n.tenant_id""")
def _(t):
    return m.approval_rate(reviewed(t), t.tenants)


@query("resolution_by_category", f"""
WITH {_REVIEWED}
SELECT n.tenant_id, s.category, count(r.ticket_id) AS resolved, round(avg(r.seconds), 6) AS avg_seconds
FROM fx_tenants n CROSS JOIN (SELECT unnest([{_CATEGORIES}]) AS category) s
LEFT JOIN reviewed r ON r.tenant_id = n.tenant_id AND r.category = s.category GROUP BY ALL""")
def _(t):
    return m.resolution_by_category(reviewed(t), t.tenants).withColumn("avg_seconds", F.round("avg_seconds", 6))


@query("resolution_overall", f"""
WITH {_REVIEWED}, per AS (SELECT tenant_id, category, count(*) AS n, avg(seconds) AS s FROM reviewed WHERE category IS NOT NULL GROUP BY ALL)
SELECT n.tenant_id, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS resolved, round(sum(p.n * p.s) / sum(p.n), 6) AS avg_seconds
FROM fx_tenants n LEFT JOIN per p ON p.tenant_id = n.tenant_id GROUP BY n.tenant_id""")
def _(t):
    return m.resolution_overall(reviewed(t), t.tenants).withColumn("avg_seconds", F.round("avg_seconds", 6))


@query("metrics_summary", f"""
WITH {_REVIEWED},
days AS (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - {DAYS - 1}, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT n.tenant_id, d.day, count(t.needs_escalation) AS processed, count(*) FILTER (t.needs_escalation) AS escalated
  FROM fx_tenants n CROSS JOIN days d LEFT JOIN fx_tickets t ON t.tenant_id = n.tenant_id AND CAST(t.created_at AS DATE) = d.day GROUP BY ALL),
per AS (SELECT n.tenant_id, s.category, count(r.ticket_id) AS resolved, avg(r.seconds) AS avg_seconds
  FROM fx_tenants n CROSS JOIN (SELECT unnest([{_CATEGORIES}]) AS category) s
  LEFT JOIN reviewed r ON r.tenant_id = n.tenant_id AND r.category = s.category GROUP BY ALL),
outcome AS (SELECT n.tenant_id, o.outcome, count(r.ticket_id) FILTER (r.flagged) AS escalated, count(r.ticket_id) FILTER (NOT r.flagged) AS not_escalated
  FROM fx_tenants n CROSS JOIN (VALUES ('approved_as_is', false), ('edited', true)) o(outcome, edited)
  LEFT JOIN reviewed r ON r.tenant_id = n.tenant_id AND r.edited = o.edited GROUP BY n.tenant_id, o.outcome),
cells AS (
SELECT n.tenant_id, 'total_tickets' AS metric, '' AS item, count(t.ticket_id)::DOUBLE AS value FROM fx_tenants n LEFT JOIN fx_tickets t USING (tenant_id) GROUP BY 1
UNION ALL SELECT n.tenant_id, 'escalation_rate', '', count(*) FILTER (t.needs_escalation) / nullif(count(t.needs_escalation), 0) FROM fx_tenants n LEFT JOIN fx_tickets t USING (tenant_id) GROUP BY 1
UNION ALL SELECT n.tenant_id, 'drafts_reviewed', '', count(r.ticket_id) FROM fx_tenants n LEFT JOIN reviewed r USING (tenant_id) GROUP BY 1
UNION ALL SELECT n.tenant_id, 'approval_rate', '', count(*) FILTER (NOT r.edited) / nullif(count(r.ticket_id), 0) FROM fx_tenants n LEFT JOIN reviewed r USING (tenant_id) GROUP BY 1
UNION ALL SELECT tenant_id, 'avg_resolution_seconds', '', sum(resolved * avg_seconds) / nullif(sum(resolved), 0) FROM per GROUP BY 1
UNION ALL SELECT n.tenant_id, 'tickets_by_status.n', s.status, count(t.ticket_id) FROM fx_tenants n CROSS JOIN (SELECT unnest([{_STATUSES}]) AS status) s
  LEFT JOIN fx_tickets t ON t.tenant_id = n.tenant_id AND t.status = s.status GROUP BY 1, 3
UNION ALL SELECT n.tenant_id, 'tickets_by_category.n', s.category, count(t.ticket_id) FROM fx_tenants n CROSS JOIN (SELECT unnest([{_CATEGORIES}]) AS category) s
  LEFT JOIN fx_tickets t ON t.tenant_id = n.tenant_id AND t.category = s.category GROUP BY 1, 3
UNION ALL SELECT tenant_id, 'escalation_by_day.processed', CAST(day AS VARCHAR), processed FROM daily
UNION ALL SELECT tenant_id, 'escalation_by_day.escalated', CAST(day AS VARCHAR), escalated FROM daily
UNION ALL SELECT tenant_id, 'review_outcomes.escalated', outcome, escalated FROM outcome
UNION ALL SELECT tenant_id, 'review_outcomes.not_escalated', outcome, not_escalated FROM outcome
UNION ALL SELECT tenant_id, 'resolution_by_category.resolved', category, resolved FROM per
UNION ALL SELECT tenant_id, 'resolution_by_category.avg_seconds', category, avg_seconds FROM per)
SELECT tenant_id, metric, item, round(value, 6) AS value FROM cells""")
def _(t):
    summary = m.metrics_summary(t.tickets, reviewed(t), t.tenants, TODAY, DAYS)
    return m.summary_long(summary).withColumn("value", F.round("value", 6))


@query("order_status_mix", """
SELECT tenant_id, status, count(*) AS n, count(*) FILTER (amount > 100) AS over_threshold FROM fx_orders GROUP BY ALL""")
def _(t):
    return m.order_status_mix(t.orders)


@query("queue_counts", """
SELECT tenant_id, count(*) FILTER (status = 'awaiting_review') AS awaiting_review,
  count(*) FILTER (status = 'awaiting_review' AND needs_escalation) AS awaiting_escalated,
  count(*) FILTER (status IN ('new', 'in_progress')) AS with_agents FROM fx_tickets GROUP BY tenant_id""")
def _(t):
    return m.queue_counts(t.tickets)


@query("chart_shares", f"""
WITH c AS (SELECT n.tenant_id, s.category, count(t.ticket_id) AS n FROM fx_tenants n CROSS JOIN (SELECT unnest([{_CATEGORIES}]) AS category) s
LEFT JOIN fx_tickets t ON t.tenant_id = n.tenant_id AND t.category = s.category GROUP BY ALL)
SELECT tenant_id, category, n, CAST(sum(n) OVER (PARTITION BY tenant_id) AS BIGINT) AS total,
  n / nullif(sum(n) OVER (PARTITION BY tenant_id), 0) AS share FROM c""")
def _(t):
    return m.chart_shares(m.tickets_by_category(t.tickets, t.tenants))


@query("outcome_totals", f"""
WITH {_REVIEWED}
SELECT n.tenant_id, o.outcome, count(r.ticket_id) FILTER (r.flagged) AS escalated, count(r.ticket_id) FILTER (NOT r.flagged) AS not_escalated, count(r.ticket_id) AS total
FROM fx_tenants n CROSS JOIN (VALUES ('approved_as_is', false), ('edited', true)) o(outcome, edited)
LEFT JOIN reviewed r ON r.tenant_id = n.tenant_id AND r.edited = o.edited GROUP BY n.tenant_id, o.outcome""")
def _(t):
    return m.outcome_totals(m.review_outcomes(reviewed(t), t.tenants))


@query("tenant_overview", """
SELECT n.tenant_id, n.slug, n.name, count(DISTINCT u.user_id) AS users, (SELECT count(*) FROM fx_tickets t WHERE t.tenant_id = n.tenant_id) AS tickets
FROM fx_tenants n LEFT JOIN fx_users u ON u.tenant_id = n.tenant_id GROUP BY ALL""")
def _(t):
    return m.tenant_overview(t.tenants, t.users, t.tickets)


@query("agent_step_latency", """
SELECT agent_name, count(*) AS runs, count(*) FILTER (output LIKE '{"error"%') AS errors, round(avg(duration_ms), 6) AS avg_ms,
  round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM fx_agent_logs GROUP BY agent_name""")
def _(t):
    out = m.agent_step_latency(t.agent_logs)
    return out.select("agent_name", "runs", "errors", *[F.round(c, 6).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms")])


@query("draft_provider_stats", """
WITH a AS (SELECT json(output) AS o, unnest(CAST(json_extract(output, '$.attempts[*]') AS JSON[])) AS a FROM fx_agent_logs WHERE agent_name = 'draft')
SELECT json_extract_string(a, '$.provider') AS provider, count(*) AS attempts, count(json_extract(a, '$.ok')) AS drafted,
  count(json_extract(a, '$.error')) AS failed, count(json_extract(a, '$.skipped')) AS skipped,
  round(avg(CAST(json_extract(o, '$.usage.input_tokens') AS BIGINT)) FILTER (json_extract(a, '$.ok') IS NOT NULL), 6) AS avg_input_tokens,
  round(avg(CAST(json_extract(o, '$.usage.output_tokens') AS BIGINT)) FILTER (json_extract(a, '$.ok') IS NOT NULL), 6) AS avg_output_tokens
FROM a GROUP BY 1""")
def _(t):
    out = m.draft_provider_stats(t.agent_logs)
    return out.select(
        "provider", "attempts", "drafted", "failed", "skipped",
        *[F.round(c, 6).alias(c) for c in ("avg_input_tokens", "avg_output_tokens")],
    )


@query("utc_day", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy(text.utc_day(F.col("ts").cast("timestamp")).cast("string").alias("day")).agg(F.count("*").alias("n"))
