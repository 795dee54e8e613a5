import random
from datetime import datetime, timedelta

from ticketloom.operators import tickets as k

START = datetime(2026, 1, 1)


def fold(ticket, newest, actions):
    """The same rules, one action at a time."""
    status, approved, cat, urg = ticket["status"], None, ticket["cc"], ticket["cu"]
    verdicts = {}
    for a in sorted(actions, key=lambda a: (a[3], a[0])):
        kind = a[2]
        if kind in ("approve", "edit"):
            ok = status == "awaiting_review" and newest is not None and newest[1] is None and approved is None
            if ok:
                status, approved = "resolved", newest[0]
            verdicts[a[0]] = "applied" if ok else "conflict"
        elif kind == "rerun":
            ok = status != "in_progress"
            status = "in_progress"
            verdicts[a[0]] = "applied" if ok else "conflict"
        else:
            ok = ticket["category"] is not None and ticket["urgency"] is not None
            if ok:
                cat = a[4] if a[4] != ticket["category"] else None
                urg = a[5] if a[5] != ticket["urgency"] else None
            verdicts[a[0]] = "applied" if ok else "not triaged"
    return (status, approved, cat, urg), verdicts


def test_actions_equal_a_sequential_fold(spark):
    rng = random.Random(3)
    tickets, drafts, actions = [], [], []
    for t in range(120):
        triaged = rng.random() < 0.8
        tickets.append(dict(tenant_id=1, ticket_id=t, status=rng.choice(["new", "in_progress", "awaiting_review", "awaiting_review", "resolved"]),
                            category="order_status" if triaged else None, urgency="low" if triaged else None, cc=rng.choice([None, "cancellation"]), cu=None))
        for n in range(rng.randrange(3)):
            drafts.append((1, t, t * 10 + n, rng.choice([None, None, True]), START + timedelta(hours=n)))
        for n in range(rng.randrange(6)):
            actions.append((t * 10 + n, t, rng.choice(["approve", "edit", "rerun", "correct"]), START + timedelta(minutes=rng.randrange(4)),
                            rng.choice(["order_status", "refund_request", None]), rng.choice(["low", "high"])))
    tdf = spark.createDataFrame(
        [(t["tenant_id"], t["ticket_id"], t["status"], t["category"], t["urgency"], t["cc"], t["cu"], None, None) for t in tickets],
        "tenant_id int, ticket_id bigint, status string, category string, urgency string, corrected_category string, corrected_urgency string, corrected_by string, corrected_at timestamp",
    )
    ddf = spark.createDataFrame(drafts, "tenant_id int, ticket_id bigint, draft_id bigint, approved boolean, created_at timestamp")
    adf = spark.createDataFrame(
        [(i, 1, t, a, at, c, u, "r1") for i, t, a, at, c, u in actions],
        "action_id bigint, tenant_id int, ticket_id bigint, action string, at timestamp, new_category string, new_urgency string, reviewer_id string",
    )
    state, judged = k.apply_review_actions(tdf, ddf, adf)
    got = {r["ticket_id"]: (r["status"], r["approved_draft_id"], r["corrected_category"], r["corrected_urgency"]) for r in state.collect()}
    verdicts = {r["action_id"]: r["verdict"] for r in judged.collect()}
    for t in tickets:
        mine = sorted((d for d in drafts if d[1] == t["ticket_id"]), key=lambda d: (d[4], d[2]))
        newest = (mine[-1][2], mine[-1][3]) if mine else None
        expected, seen = fold(t, newest, [a for a in actions if a[1] == t["ticket_id"]])
        assert got[t["ticket_id"]] == expected
        assert {i: verdicts[i] for i in seen} == seen


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([(1, "Ann Lee", "ann@x.io"), (2, "Bo_100% Ray", "bo@x.io"), (3, "Cy", "CY@X.IO")], "customer_id bigint, name string, email string")
    assert [r[0] for r in k.customer_search(df, "_100%", 5).select("customer_id").collect()] == [2]
    assert [r[0] for r in k.customer_search(df, "x.IO", 2).select("customer_id").collect()] == [1, 2]
    assert k.customer_search(df, None, 2).count() == 2


def test_no_tenant_matches_nothing(spark):
    df = spark.createDataFrame([(1,), (2,)], "tenant_id int")
    assert k.scoped(df, None).count() == 0 and k.scoped(df, 2).count() == 1
