"""Registered streaming queries: the driver tables arrive as file streams."""

from pyspark.sql import functions as F

from ..operators.triage import triage
from ..session import shared_dir
from ..streaming import jobs, sinks
from .models import SECONDS, _walk, given_labels
from .registry import query
from .text import _REASONS
from .tickets import _INTAKE, _RUNS


def stream_view(t, view: str, table: str):
    """An input view with one driver table replaced by its stream."""
    return t.streaming(view, table, sinks.table_stream(t.spark, t.sf_dir, table))


@query("stream_intake", f"WITH {_INTAKE} SELECT DISTINCT tenant_id, email, body FROM intake WHERE verdict = 'accepted'")
def _(t):
    requests = stream_view(t, "fx_requests", "conversations").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("request_id")))
    return sinks.run_to_end(jobs.intake(requests)).select("tenant_id", "email", "body")


@query("stream_triage", f"""
WITH {_REASONS} SELECT r.tenant_id, r.ticket_id, r.category, r.urgency, CASE WHEN r.category IS NULL THEN true ELSE len(reasons) > 0 END AS needs_escalation,
  CASE WHEN r.category IS NULL THEN 'Agent pipeline failed (no label); review manually or rerun' ELSE nullif(array_to_string(reasons, '; '), '') END AS escalation_reason FROM r""")
def _(t):
    tickets = stream_view(t, "fx_tickets", "events")
    out = sinks.run_to_end(jobs.continuous_triage(tickets, given_labels(t), t.orders))
    return out.select("tenant_id", "ticket_id", "category", "urgency", "needs_escalation", "escalation_reason")


@query("stream_escalation_daily", """
SELECT tenant_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(needs_escalation) AS processed, count(*) FILTER (needs_escalation) AS escalated FROM fx_tickets GROUP BY ALL""")
def _(t):
    updates = sinks.run_to_end(jobs.escalation_daily(stream_view(t, "fx_tickets", "events")), "update")
    return sinks.latest_per_key(updates, ["tenant_id", "day"]).withColumn("day", F.col("day").cast("string"))


@query("stream_rate_limit", f"WITH RECURSIVE {_walk('u', 'fx_attempts', 'visitor', 2)} SELECT attempt_id, allowed FROM u")
def _(t):
    """Verdicts of the stream, and of the attempts that it still holds at the end of its input."""
    attempts, base = stream_view(t, "fx_attempts", "events"), shared_dir(t.spark, "limits")
    judged = sinks.run_to_end(jobs.rate_limited(attempts, "visitor", 2, SECONDS, "1 hour"), base=base)
    rest = jobs.undecided(t.spark, f"{base}/checkpoint", 2, SECONDS)
    return judged.select("attempt_id", "allowed").unionByName(rest.select("attempt_id", "allowed"))


@query("stream_rate_suspects", """
WITH w AS (SELECT business AS key, time_bucket(INTERVAL '2 hours', ts) - k * INTERVAL '2 hours' AS start FROM fx_attempts CROSS JOIN unnest([0, 1, 2]) u(k))
SELECT key, epoch_us(start) AS start_us, count(*) AS attempts FROM w GROUP BY ALL HAVING count(*) > 5""")
def _(t):
    attempts = stream_view(t, "fx_attempts", "events")
    updates = sinks.run_to_end(jobs.sliding_suspects(attempts, "business", 5, "6 hours", "2 hours"), "update")
    out = sinks.latest_per_key(updates, ["key", "window_start"])
    return out.select("key", F.unix_micros("window_start").alias("start_us"), "attempts")


def run_reports(logs):
    """The last state of every run; `stuck` if its event-time deadline passed before anything further came."""
    return sinks.latest_per_key(sinks.run_to_end(jobs.run_tracker(logs), "update"), ["ticket_id", "run_no"], "version")


# an hour without a step, before the next run or the last watermark (an hour behind the newest log)
_REPORTS = f"""WITH {_RUNS}, last AS (SELECT ticket_id, run_no, epoch_ms(max(created_at)) AS last_ms, epoch_ms(min(created_at)) AS first_ms FROM numbered GROUP BY ALL),
until AS (SELECT ticket_id, CAST(run_no AS BIGINT) AS run_no, last_ms, coalesce(lead(first_ms) OVER (PARTITION BY ticket_id ORDER BY run_no), (SELECT epoch_ms(max(created_at)) - 3600000 FROM fx_agent_logs)) AS until_ms FROM last)
SELECT ticket_id, run_no, logs, finished, failed, NOT finished AND until_ms >= last_ms + 3600000 AS stuck FROM runs JOIN until USING (ticket_id, run_no)"""


@query("stream_agent_runs", _REPORTS)
def _(t):
    return run_reports(stream_view(t, "fx_agent_logs", "events"))


@query("stream_run_reports", f"SELECT * FROM ({_REPORTS}) WHERE stuck")
def _(t):
    return run_reports(stream_view(t, "fx_agent_logs", "events")).where("stuck")


@query("stream_resume", """
SELECT tenant_id, ticket_id, 'awaiting_review' AS status FROM fx_tickets WHERE status IN ('new', 'in_progress')""")
def _(t):
    """A job and its restart on the same checkpoint: finished work is not done again."""
    tickets = stream_view(t, "fx_tickets", "events").filter(F.col("status").isin("new", "in_progress"))
    job = triage(tickets, given_labels(t), t.orders)
    base = shared_dir(t.spark, "resume")
    for _run in ("first", "restart"):
        sinks.start(job, f"{base}/out", f"{base}/checkpoint", "append").awaitTermination()
    return sinks.written(t.spark, f"{base}/out", job).select("tenant_id", "ticket_id", "status")
