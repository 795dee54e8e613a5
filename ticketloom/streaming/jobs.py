"""Streaming jobs. Each returns a streaming frame; sinks.py runs it."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tickets import contact_intake
from ..operators.triage import triage


def intake(requests: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Accepted contact requests as tickets; a message sent again within the watermark is dropped.

    `requests` carries an event time `ts`.
    """
    accepted = contact_intake(requests.withWatermark("ts", watermark)).filter("verdict = 'accepted'")
    columns = ["request_id", "tenant_id", "name", "email", "subject", "body", "ts"]
    return accepted.select(*columns).dropDuplicatesWithinWatermark(["tenant_id", "email", "body"])


def continuous_triage(tickets: DataFrame, labels: DataFrame, orders: DataFrame) -> DataFrame:
    """Triage of arriving tickets against static orders and labels: stateless, any trigger works."""
    return triage(tickets, labels, orders)


def escalation_daily(tickets: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Decided and escalated tickets per tenant and UTC day; late rows count up to the watermark."""
    return (
        tickets.withWatermark("created_at", watermark)
        .groupBy("tenant_id", F.window("created_at", "1 day").alias("w"))
        .agg(F.count("needs_escalation").alias("processed"), F.count_if(F.col("needs_escalation")).alias("escalated"))
        .select("tenant_id", F.to_date("w.start").alias("day"), "processed", "escalated")
    )


def sliding_suspects(attempts: DataFrame, key: str, limit: int, length: str = "1 hour", slide: str = "5 minutes", watermark: str = "1 hour") -> DataFrame:
    """Keys with more than `limit` attempts in a sliding window; partial counts combine before the shuffle."""
    return (
        attempts.withWatermark("ts", watermark)
        .groupBy(F.col(key).alias("key"), F.window("ts", length, slide).alias("w"))
        .agg(F.count("*").alias("attempts"))
        .filter(F.col("attempts") > limit)
        .select("key", F.col("w.start").alias("window_start"), "attempts")
    )


# --- rate limits ---------------------------------------------------------------------------

GROUPS = 1024  # of keys, in the state of a stream; a call of a group costs some 40 ms, most of it waiting for the state store


def group_of(key: str) -> list[Column]:
    """The group of a key in the state of a stream, by its hash; null is in a group of its own."""
    return [F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("__group"), F.col(key).isNull().alias("__null")]


class GroupTimer:
    """The one event-time timer of a group, in milliseconds."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.at = handle, handle.getValueState("timer", "at bigint")

    def gone(self) -> None:
        """The timer has expired."""
        self.at.clear()

    def set(self, at: int | None, now: int) -> None:
        """Wakes the group at this time, or at none; later than the watermark `now`."""
        before = self.at.get()[0] if self.at.exists() else None
        at = None if at is None else max(at, now + 1)
        if at == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.at.clear()
        else:
            self.handle.registerTimer(at)
            self.at.update((at,))

    def sooner(self, micros: int, now: int) -> None:
        """Wakes the group at this time if nothing wakes it before."""
        at = max(-(-micros // 1000), now + 1)
        if not self.at.exists() or self.at.get()[0] > at:
            self.set(at, now)


VERDICT = "attempt_id bigint, key string, at bigint, allowed boolean"


def take_turns(waiting: list[tuple[int, int]], held: list[int], limit: int, width: int) -> tuple[list[bool], list[int]]:
    """Verdicts of attempts (at, attempt_id), oldest first, after the allowed times `held`; the times that still count."""
    room = deque(sorted(held))
    verdicts = []
    for at, _ in waiting:
        while room and room[0] <= at - width:
            room.popleft()
        verdicts.append(len(room) < limit)
        if verdicts[-1]:
            room.append(at)
    return verdicts, list(room)


class Limiter(StatefulProcessor):
    """Judges the attempts of a group of keys as they come, or, if it holds them, in the order of their times once the watermark
    has passed them.

    `pending`: attempts that an earlier one may still precede. `allowed`: at most `limit` times a key, of the last window; an
    event-time timer removes them once the window has passed (a time-to-live of the state store runs on the wall clock, so verdicts
    would depend on the speed of the stream). Both are lists of the whole group, and their elements are blocks of rows, column by column,
    so that neither a key nor an attempt costs an exchange with the state store of its own.
    """

    def __init__(self, limit: int, width: int, hold: bool):
        self.limit, self.width, self.hold = limit, width, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "key array<string>, at array<bigint>, attempt_id array<bigint>")
        self.allowed = handle.getListState("allowed", "key array<string>, at array<bigint>")
        self.timer = GroupTimer(handle)

    def handleInputRows(self, key, rows, timerValues):
        fresh = [r for batch in rows for r in zip(*(batch[c].tolist() for c in ("key", "at", "attempt_id")))]
        if self.hold:
            self.pending.appendValue(_block(fresh))
            self.timer.sooner(min(r[1] for r in fresh), timerValues.getCurrentWatermarkInMs())
        else:
            yield self._judge(fresh, [], None, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.gone()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        pending = list(_listed(self.pending))
        rest = [r for r in pending if r[1] > passed]
        _replace(self.pending, rest)
        yield self._judge([r for r in pending if r[1] <= passed], rest, passed, timerValues)

    def _judge(self, ripe: list[tuple], rest: list[tuple], passed: int | None, timerValues) -> pd.DataFrame:
        """Verdicts on `ripe`, of (key, at, attempt_id). What an attempt of `rest`, or after `passed`, can still meet is held; without
        `passed`, after the key's last attempt."""
        turns, held, first = {}, {}, {}
        for key, at, attempt in ripe:
            turns.setdefault(key, []).append((at, attempt))
        for key, at in _listed(self.allowed):
            held.setdefault(key, []).append(at)
        for key, at, _ in rest:
            first[key] = min(at, first.get(key, at))
        found, kept, wake = [], [], [min(first.values())] if first else []
        for key in {**held, **turns}:
            waiting = sorted(turns.get(key, []))
            verdicts, times = take_turns(waiting, held.get(key, []), self.limit, self.width)
            found += [(attempt, key, at, v) for (at, attempt), v in zip(waiting, verdicts)]
            now = passed if passed is not None else waiting[-1][0] if waiting else None
            times = [t for t in times if now is None or t > first.get(key, now) - self.width]
            kept += [(key, t) for t in times]
            if times and key not in first:
                wake.append(max(times) + self.width)
        _replace(self.allowed, kept)
        self.timer.set(-(-min(wake) // 1000) if wake else None, timerValues.getCurrentWatermarkInMs())
        return pd.DataFrame(found, columns=["attempt_id", "key", "at", "allowed"])

    def close(self) -> None:
        pass


def _replace(state, values: list[tuple]) -> None:
    state.put([_block(values)]) if values else state.clear()


def _block(rows: list[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows)))


def _listed(state) -> Iterator[tuple]:
    """The rows of all blocks of a list."""
    return (row for block in state.get() for row in zip(*block)) if state.exists() else iter(())


def rate_limited(attempts: DataFrame, key: str, limit: int, seconds: int, lateness: str | None = None) -> DataFrame:
    """Allow or refuse each attempt: (attempt_id, key, at, allowed).

    Without `lateness`, attempts are judged as they arrive, each micro-batch in the order of its times. With it, an attempt is
    judged once the watermark says that nothing earlier can arrive: verdicts then equal those of `limits.decisions` whatever
    the order of arrival, as long as no attempt is later than `lateness`. Attempts that the watermark has not passed when the
    stream ends are in its state: `undecided` gives their verdicts. The state of a key is its held attempts and at most `limit`
    times, and is gone once a window has passed without an attempt. Needs the RocksDB state store, which `session.configure`
    chooses.
    """
    shaped = attempts.withWatermark("ts", lateness or "1 hour").select(*group_of(key), F.col(key).alias("key"), "attempt_id", "ts", F.unix_micros("ts").alias("at"))
    limiter = Limiter(limit, seconds * 1_000_000, lateness is not None)
    return shaped.groupBy("__group", "__null").transformWithStateInPandas(limiter, VERDICT, "Append", "EventTime")


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The rows of the blocks of a list in the state that a stopped stream has left."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    columns = [F.col(f"list_element.{c}") for c in held.schema["list_element"].dataType.names]
    return held.select(F.inline(F.arrays_zip(*columns)))


def undecided(spark: SparkSession, checkpoint: str, limit: int, seconds: int) -> DataFrame:
    """Verdicts on the attempts that a stopped `rate_limited` stream still holds, judged as if no earlier one were to come."""

    def judge(group, pending: pd.DataFrame, allowed: pd.DataFrame) -> pd.DataFrame:
        turns, held = {}, {}
        for key, at, attempt in zip(*(pending[c].tolist() for c in ("key", "at", "attempt_id"))):
            turns.setdefault(key, []).append((at, attempt))
        for key, at in zip(allowed["key"].tolist(), allowed["at"].tolist()):
            held.setdefault(key, []).append(at)
        found = []
        for key, waiting in turns.items():
            verdicts, _ = take_turns(sorted(waiting), held.get(key, []), limit, seconds * 1_000_000)
            found += [(attempt, key, at, v) for (at, attempt), v in zip(sorted(waiting), verdicts)]
        return pd.DataFrame(found, columns=["attempt_id", "key", "at", "allowed"])

    pending, allowed = (state_of(spark, checkpoint, name).select("*", *group_of("key")).groupBy("__group", "__null") for name in ("pending", "allowed"))
    return pending.cogroup(allowed).applyInPandas(judge, VERDICT)


# --- runs ----------------------------------------------------------------------------------

TRIAGE, ENDED, FAILED = 1, 2, 4  # what a step says, as bits
REPORT = "ticket_id bigint, run_no bigint, logs bigint, finished boolean, failed boolean, stuck boolean, version bigint"


@dataclass
class Run:
    """A run: where it opened, what of it lies before the watermark, and its later steps (at, log_id, bits) in order."""

    opened: tuple[int, int]
    settled: tuple[int, int, int] = (0, 0, 0)  # steps, their bits, last time
    steps: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def logs(self) -> int:
        return self.settled[0] + len(self.steps)

    @property
    def bits(self) -> int:
        return reduce(or_, (b for *_, b in self.steps), self.settled[1])

    @property
    def last(self) -> int:
        return self.steps[-1][0] if self.steps else self.settled[2]

    def settle(self, passed: int) -> None:
        old = [s for s in self.steps if s[0] <= passed]
        if old:
            self.settled = (self.settled[0] + len(old), reduce(or_, (b for *_, b in old), self.settled[1]), old[-1][0])
            self.steps = self.steps[len(old) :]


def split_runs(first: Run | None, steps: Iterable[tuple[int, int, int]]) -> list[Run]:
    """Runs of steps in the order of their times, after the settled part of `first`: a triage step opens one, and so does the
    first step of all."""
    runs = [] if first is None or not first.settled[0] else [Run(first.opened, first.settled)]
    for at, log_id, bits in sorted(set(steps)):
        if bits & TRIAGE or not runs:
            runs.append(Run((at, log_id)))
        runs[-1].steps.append((at, log_id, bits))
    return runs


class RunTracker(StatefulProcessor):
    """Runs of the tickets of a group by event time. Steps after the watermark are kept one by one and split anew when one comes in
    between, so a late step changes the run it belongs to; what the watermark has passed is kept as totals, and a run that nothing
    can reach any more leaves the state.

    The state of a group is one value, pickled: of each ticket the number of runs gone, the reports so far, the time to look at it
    again, and its runs. The timer is the earliest of the tickets'. So a ticket costs no exchange with the state store of its own.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tickets = handle.getValueState("tickets", "data binary")
        self.timer = GroupTimer(handle)

    def handleInputRows(self, key, rows, timerValues):
        fresh: dict[int, list[tuple[int, int, int]]] = {}
        for batch in rows:
            for ticket, *step in zip(*(batch[c].tolist() for c in ("ticket_id", "at", "log_id", "bits"))):
                fresh.setdefault(ticket, []).append(tuple(step))
        yield self._advance(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.gone()
        yield self._advance(key, {}, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, fresh: dict[int, list[tuple[int, int, int]]], timerValues) -> pd.DataFrame:
        """Reports on the tickets with new steps, or, without any, on those whose time has come."""
        now, rows = timerValues.getCurrentWatermarkInMs(), []
        held = pickle.loads(bytes(self.tickets.get()[0])) if self.tickets.exists() else {}
        for ticket in fresh or [k for k, (_, _, wake, _) in held.items() if wake is not None and wake <= now]:
            held[ticket] = self._step(ticket, held.get(ticket, (0, 0, None, [])), fresh.get(ticket, []), now, rows)
        self.tickets.update((pickle.dumps(held, 5),))
        self.timer.set(min((wake for _, _, wake, _ in held.values() if wake is not None), default=None), now)
        found = pd.DataFrame(rows, columns=["ticket_id", "run_no", "logs", "finished", "failed", "stuck", "version"])
        return found.assign(ticket_id=None) if key[1] else found

    def _step(self, ticket: int, state: tuple, fresh: list[tuple[int, int, int]], now: int, rows: list[tuple]) -> tuple:
        gone, version, _, before = state
        late = [s for *_, steps in before for s in steps]
        runs = split_runs(Run(*before[0]) if before else None, [*late, *fresh])
        for n, run in enumerate(runs):
            until = runs[n + 1].opened[0] // 1000 if n + 1 < len(runs) else now
            stuck = not run.bits & ENDED and until >= run.last // 1000 + self.wait
            rows.append((ticket, gone + n + 1, run.logs, bool(run.bits & ENDED), bool(run.bits & FAILED), stuck, version + 1))
        for run in runs:
            run.settle(now * 1000)
        while len(runs) > 1 and runs[1].settled[0]:
            runs, gone = runs[1:], gone + 1
        last = runs[-1]
        wake = max(last.last // 1000 + (1 if last.bits & ENDED else self.wait), now + 1) if fresh else None
        return gone, version + 1, wake, [(r.opened, r.settled, r.steps) for r in runs]


def run_tracker(logs: DataFrame, stuck_after: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Runs from arriving step logs, as updates: the last version of a run holds. A run is closed at the escalation step, an error,
    or the next triage step; one that is not, and that has no step for `stuck_after` of event time before the next run or the
    watermark, is stuck.

    The runs equal those of `runs.agent_runs` whatever the order of arrival, as long as no step is later than `lateness`.
    """
    failed = F.coalesce(F.get_json_object("output", "$.error").isNotNull(), F.lit(False))
    bits = F.when(F.col("agent_name") == "triage", TRIAGE).otherwise(0) + F.when(failed, ENDED + FAILED).when(F.col("agent_name") == "escalation", ENDED).otherwise(0)
    ticket = F.coalesce("ticket_id", F.lit(0)).alias("ticket_id")
    shaped = logs.withWatermark("created_at", lateness).select(
        *group_of("ticket_id"), ticket, "log_id", "created_at", F.unix_micros("created_at").alias("at"), bits.cast("bigint").alias("bits")
    )
    wait = int(pd.Timedelta(stuck_after).total_seconds() * 1000)
    return shaped.groupBy("__group", "__null").transformWithStateInPandas(RunTracker(wait), REPORT, "Update", "EventTime")
