import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from test_scale import brute_limit
from ticketloom.streaming import jobs, sinks

START = datetime(2026, 1, 1)


def files(spark, path, parts, schema, first=0):
    """One file per part, so that each is its own micro-batch, oldest first."""
    for n, part in enumerate(parts, first):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_limits_hold_across_micro_batches(spark, tmp_path):
    attempts = [(i, f"k{i % 2}", i * 3 // 2) for i in range(60)]
    schema = "attempt_id bigint, who string, ts timestamp"
    parts = [[(i, k, START + timedelta(seconds=t)) for i, k, t in attempts[n : n + 20]] for n in (0, 20, 40)]
    stream = files(spark, str(tmp_path / "in"), parts, schema)
    out = sinks.run_to_end(jobs.rate_limited(stream, "who", 3, 10))
    assert {r["attempt_id"]: r["allowed"] for r in out.collect()} == brute_limit(attempts, 3, 10)
    assert out.select("batch_id").distinct().count() > 1


def test_held_attempts_are_judged_as_in_the_batch_form(spark, tmp_path):
    """Shuffled within the lateness, over several batches and a restart, with the rest read back from the state."""
    from ticketloom.operators import limits

    rng = random.Random(5)
    attempts = [(i, f"k{rng.randrange(3)}", i * 7 + rng.randrange(5)) for i in range(150)]
    schema = "attempt_id bigint, who string, ts timestamp"
    late = sorted(attempts, key=lambda r: r[2] + rng.randrange(300))  # arrives up to 300 seconds late
    parts = [[(i, k, START + timedelta(seconds=t)) for i, k, t in late[n : n + 40]] for n in range(0, 150, 40)]
    base, source = str(tmp_path / "run"), str(tmp_path / "in")
    out = None
    for upto in (2, 4):  # the second time the same checkpoint goes on
        stream = files(spark, source, parts[upto - 2 : upto], schema, upto - 2)
        out = sinks.run_to_end(jobs.rate_limited(stream, "who", 3, 60, "301 seconds"), base=base)
    judged = {r.attempt_id: r.allowed for r in out.collect()}
    rest = {r.attempt_id: r.allowed for r in jobs.undecided(spark, f"{base}/checkpoint", 3, 60).collect()}
    assert judged and rest and not set(judged) & set(rest)
    assert {**judged, **rest} == brute_limit(attempts, 3, 60)
    table = spark.createDataFrame([(i, k, START + timedelta(seconds=t)) for i, k, t in attempts], schema)
    assert {r.attempt_id: r.allowed for r in limits.decisions(table, "who", 3, 60).collect()} == {**judged, **rest}


def test_state_of_a_limiter_is_empty_after_the_window(spark, tmp_path):
    schema = "attempt_id bigint, who string, ts timestamp"
    row = lambda i, who, s: (i, who, START + timedelta(seconds=s))
    parts = [[row(k, "a", k) for k in range(9)], [row(20, "b", 100_000)], [row(21, "c", 200_000)]]
    base = str(tmp_path / "run")
    out = sinks.run_to_end(jobs.rate_limited(files(spark, str(tmp_path / "in"), parts, schema), "who", 3, 60, "1 minute"), base=base)
    assert rows(out.filter("allowed"), "attempt_id") == [(0,), (1,), (2,), (20,)]
    held = {name: rows(jobs.state_of(spark, f"{base}/checkpoint", name), "key") for name in ("pending", "allowed")}
    assert held == {"pending": [("c",)], "allowed": []}


def test_late_steps_reach_the_run_they_belong_to(spark, tmp_path):
    """Logs in any order within the lateness: the runs of the batch form, with the stuck ones marked."""
    from ticketloom.operators.runs import agent_runs

    rng = random.Random(11)
    logs = []
    for ticket in range(12):
        at = rng.randrange(600)
        for _ in range(rng.randrange(1, 40)):
            at += rng.choice([1, 5, 30, 30, 240])
            agent = rng.choice(["triage", "knowledge", "draft", "order_lookup", "escalation"])
            logs.append((len(logs), ticket, agent, '{"error": "x"}' if rng.random() < 0.1 else "{}", START + timedelta(minutes=at)))
    schema = "log_id bigint, ticket_id bigint, agent_name string, output string, created_at timestamp"
    shuffled = sorted(logs, key=lambda r: r[4] + timedelta(minutes=rng.randrange(120)))
    parts = [shuffled[n::1][:60] for n in range(0, len(shuffled), 60)]
    out = sinks.run_to_end(jobs.run_tracker(files(spark, str(tmp_path / "in"), parts, schema), "2 hours", "2 hours"), "update")
    latest = sinks.latest_per_key(out, ["ticket_id", "run_no"], "version")
    batch = agent_runs(spark.createDataFrame(logs, schema))
    assert len(parts) > 2 and rows(latest, "ticket_id", "run_no", "logs", "finished", "failed") == rows(batch, "ticket_id", "run_no", "logs", "finished", "failed")
    newest = max(r[4] for r in logs) - timedelta(hours=2)
    numbered = {}
    for log_id, ticket, agent, output, at in sorted(logs, key=lambda r: (r[1], r[4], r[0])):
        runs = numbered.setdefault(ticket, [])
        if agent == "triage" or not runs:
            runs.append([])
        runs[-1].append((at, agent == "escalation" or "error" in output))
    expected = []
    for ticket, runs in numbered.items():
        for n, run in enumerate(runs):
            until = runs[n + 1][0][0] if n + 1 < len(runs) else newest
            expected.append((ticket, n + 1, not any(e for _, e in run) and until >= run[-1][0] + timedelta(hours=2)))
    assert rows(latest, "ticket_id", "run_no", "stuck") == sorted(expected, key=str) and any(s for *_, s in expected)


def test_runs_are_tracked_across_micro_batches(spark, tmp_path):
    schema = "log_id bigint, ticket_id bigint, agent_name string, output string, created_at timestamp"
    log = lambda i, agent, out="{}": (i, 1, agent, out, START + timedelta(minutes=i))
    parts = [[log(1, "triage"), log(2, "knowledge")], [log(3, "draft", '{"error": "x"}'), log(4, "triage")], [log(5, "escalation")]]
    out = sinks.run_to_end(jobs.run_tracker(files(spark, str(tmp_path / "in"), parts, schema)))
    latest = sinks.latest_per_key(out.filter("NOT stuck"), ["ticket_id", "run_no"])
    assert rows(latest, "run_no", "logs", "finished", "failed") == [(1, 3, True, True), (2, 2, True, False)]


def test_a_run_that_times_out_over_several_batches_is_reported_stuck(spark, tmp_path):
    from ticketloom.plans.streams import run_reports

    schema = "log_id bigint, ticket_id bigint, agent_name string, output string, created_at timestamp"
    log = lambda i, ticket, agent, hours: (i, ticket, agent, "{}", START + timedelta(hours=hours))
    parts = [
        [log(1, 1, "triage", 0), log(2, 3, "triage", 0)], [log(3, 1, "knowledge", 0.5), log(4, 2, "triage", 5)],
        [log(5, 2, "escalation", 10)], [log(6, 3, "escalation", 10.5)],
    ]
    out = run_reports(files(spark, str(tmp_path / "in"), parts, schema))
    # the first never ends; the third was late and then went on
    assert rows(out, "ticket_id", "run_no", "logs", "finished", "stuck") == [(1, 1, 2, False, True), (2, 1, 2, True, False), (3, 1, 2, True, False)]


def test_daily_counts_arrive_late_but_whole(spark, tmp_path):
    schema = "tenant_id int, needs_escalation boolean, created_at timestamp"
    parts = [[(1, True, START), (1, None, START)], [(1, False, START + timedelta(hours=20)), (2, True, START)]]
    out = sinks.run_to_end(jobs.escalation_daily(files(spark, str(tmp_path / "in"), parts, schema)), "update")
    latest = sinks.latest_per_key(out, ["tenant_id", "day"])
    assert rows(latest, "tenant_id", "processed", "escalated") == [(1, 2, 1), (2, 1, 1)]


def test_a_failed_batch_is_repeated_once(spark, tmp_path):
    schema = "id bigint"
    stream = files(spark, str(tmp_path / "in"), [[(1,), (2,)], [(3,)]], schema).withColumn("x", F.col("id") * 2)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def interrupt(batch_id):
        if batch_id == 1:
            raise RuntimeError("stopped after the write")

    with pytest.raises(Exception, match="stopped after the write"):
        sinks.start(stream, out, checkpoint, "append", interrupt).awaitTermination()
    sinks.start(stream, out, checkpoint, "append").awaitTermination()
    assert rows(sinks.written(spark, out, stream), "id", "x") == [(1, 2), (2, 4), (3, 6)]


def test_a_message_sent_twice_is_kept_once(spark, tmp_path):
    schema = "request_id bigint, tenant_id int, name string, email string, subject string, message string, website string, ts timestamp"
    row = lambda i, mail="a@x.io", text="my parcel is late", web="": (i, 1, "Ann", mail, "Hi", text, web, START + timedelta(minutes=i))
    parts = [[row(1), row(2, web="http://spam"), row(3, "nobody")], [row(4, "A@x.io"), row(5, text="another message")]]
    out = sinks.run_to_end(jobs.intake(files(spark, str(tmp_path / "in"), parts, schema)))
    assert rows(out, "request_id") == [(1,), (5,)]


def test_a_table_is_streamed_as_one_file_or_as_a_folder(spark, tmp_path):
    frame = spark.createDataFrame([(n, f"t{n}") for n in range(20)], "id bigint, text string")
    frame.repartition(3).write.parquet(str(tmp_path / "folder" / "turns.parquet"))
    (tmp_path / "file").mkdir()
    frame.coalesce(1).toPandas().to_parquet(str(tmp_path / "file" / "turns.parquet"))
    frame.write.parquet(str(tmp_path / "folder" / "others.parquet"))
    for kind in ("folder", "file"):
        out = sinks.run_to_end(sinks.table_stream(spark, str(tmp_path / kind), "turns"))
        assert rows(out, "id", "text") == rows(frame)


def test_keys_of_a_group_share_its_state(spark, tmp_path, monkeypatch):
    """Many tickets, and many limited keys with a null among them, in four groups: the rows do not change, the state has a value a group."""
    monkeypatch.setattr(jobs, "GROUPS", 4)
    schema = "log_id bigint, ticket_id bigint, agent_name string, output string, created_at timestamp"
    log = lambda i, ticket, agent, minutes: (i, ticket, agent, "{}", START + timedelta(minutes=minutes))
    parts = [[log(k, k, "triage", k) for k in range(60)] + [log(99, None, "triage", 0)], [log(100 + k, k, "escalation", 60 + k) for k in range(0, 60, 2)], [log(200, 900, "triage", 900)]]
    base = str(tmp_path / "runs")
    out = sinks.run_to_end(jobs.run_tracker(files(spark, str(tmp_path / "logs"), parts, schema)), "update", base)
    latest = sinks.latest_per_key(out, ["ticket_id", "run_no"], "version")
    expected = [(k, 1, 2 - k % 2, k % 2 == 0, k % 2 == 1) for k in range(60)] + [(None, 1, 1, False, True), (900, 1, 1, False, False)]
    assert rows(latest, "ticket_id", "run_no", "logs", "finished", "stuck") == sorted(expected, key=str)
    held = spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", "tickets").load()
    assert held.count() <= 5  # and the group of the null

    attempts = [(i, f"k{i % 30}" if i % 31 else None, i) for i in range(300)]
    stream = files(spark, str(tmp_path / "in"), [[(i, k, START + timedelta(seconds=t)) for i, k, t in attempts]], "attempt_id bigint, who string, ts timestamp")
    base = str(tmp_path / "limits")
    judged = sinks.run_to_end(jobs.rate_limited(stream, "who", 2, 100, "30 seconds"), base=base)
    rest = jobs.undecided(spark, f"{base}/checkpoint", 2, 100)
    assert rest.count() == 30 and {r.attempt_id: r.allowed for r in judged.collect() + rest.collect()} == brute_limit(attempts, 2, 100)
