from datetime import date, datetime, timedelta

import pytest

from ticketloom.operators import metrics as m

TODAY = date(2026, 3, 5)
TICKET = "tenant_id int, ticket_id bigint, status string, category string, needs_escalation boolean, created_at timestamp"
DRAFT = "tenant_id int, ticket_id bigint, approved boolean, edited_text string, reviewed_at timestamp"


def at(day, hour=9):
    return datetime(day.year, day.month, day.day, hour)


@pytest.fixture(scope="module")
def frames(spark):
    yesterday = TODAY - timedelta(days=1)
    tickets = [
        (1, 1, "resolved", "refund_request", False, at(yesterday)),
        (1, 2, "resolved", "refund_request", True, at(TODAY)),
        (1, 3, "resolved", "damaged_item", False, at(TODAY)),
        (1, 4, "awaiting_review", "refund_request", True, at(TODAY)),
        (1, 5, "in_progress", None, None, at(TODAY)),
    ]
    drafts = [
        (1, 1, True, None, at(yesterday, 10)), (1, 2, True, "better", at(TODAY, 12)), (1, 3, True, None, at(TODAY, 11)),
        (1, 4, None, None, None), (1, 1, None, None, None),
    ]
    tenants = spark.createDataFrame([(1,), (2,)], "tenant_id int")
    return spark.createDataFrame(tickets, TICKET), spark.createDataFrame(drafts, DRAFT), tenants


def summary(frames, days):
    tickets, drafts, tenants = frames
    out = m.metrics_summary(tickets, m.reviewed_drafts(drafts, tickets), tenants, TODAY, days)
    return {r["tenant_id"]: r for r in out.collect()}


def test_five_tickets(frames):
    s = summary(frames, 2)[1]
    assert s["total_tickets"] == 5
    assert [c["n"] for c in s["tickets_by_status"]] == [0, 1, 1, 3]
    assert {c["category"]: c["n"] for c in s["tickets_by_category"]}["refund_request"] == 3
    assert s["escalation_rate"] == pytest.approx(0.5)
    assert [(d["processed"], d["escalated"]) for d in s["escalation_by_day"]] == [(1, 0), (3, 2)]
    assert s["drafts_reviewed"] == 3 and s["approval_rate"] == pytest.approx(2 / 3)
    assert [tuple(o) for o in s["review_outcomes"]] == [("approved_as_is", 0, 2), ("edited", 1, 0)]
    assert s["avg_resolution_seconds"] == pytest.approx(2 * 3600)
    by_category = {r["category"]: (r["resolved"], r["avg_seconds"]) for r in s["resolution_by_category"]}
    assert by_category["refund_request"] == (2, 7200.0) and by_category["cancellation"] == (0, None)


def test_a_tenant_without_tickets_gets_zeroes_and_nulls(frames):
    s = summary(frames, 3)[2]
    assert s["total_tickets"] == 0 and s["escalation_rate"] is None and s["approval_rate"] is None
    assert len(s["escalation_by_day"]) == 3 and all(d["processed"] == 0 for d in s["escalation_by_day"])
    assert s["avg_resolution_seconds"] is None


def test_days_add_up_to_the_decided_total(frames):
    tickets, _, tenants = frames
    daily = m.escalation_by_day(tickets, tenants, TODAY, 30).groupBy("tenant_id").sum("processed").collect()
    rate = {r["tenant_id"]: r["decided"] for r in m.escalation_rate(tickets, tenants).collect()}
    assert {r[0]: r[1] for r in daily} == rate


def test_day_filter_reaches_the_scan(spark, frames, tmp_path):
    tickets, _, tenants = frames
    tickets.write.parquet(str(tmp_path / "t"))
    plan = m.escalation_by_day(spark.read.parquet(str(tmp_path / "t")), tenants, TODAY, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in plan
