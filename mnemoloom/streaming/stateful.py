"""Keyed state across micro-batches: where a session stands, and what has become of a job.

State is a few numbers per key. What is kept is always the value with the highest sequence number, so the answer does not
depend on the order in which files or batches arrive. An event-time timer drops a key's state a while after
its last event; its last row says so. Events older than the watermark are dropped by the engine, so
`lateness` must cover the disorder of the input: for a replay of files in any order, the span of their times
(`replay_lateness`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from .events import LATENESS, _blocks, _get

QUIET = "1 day"


def session_facts(events: DataFrame, session: str = "session", order: str = "seq", at: str | None = None) -> DataFrame:
    """(session, seq[, at], kind, agent, tools, cost, sign_in) per protocol event: what it tells about its session, without its text."""
    kind = _get("$.type")
    init = (kind == "system") & (_get("$.subtype") == "init")
    speaks = lambda b: (b["type"] == "text") & (F.trim(b["text"]) != "") & b["text"].rlike(fixed.NEEDS_SIGN_IN)
    return events.filter("event is not null").select(
        F.col(session).alias("session"), F.col(order).cast("bigint").alias("seq"), *([F.col(at).alias("at")] if at else []), F.coalesce(kind, F.lit("")).alias("kind"),
        F.when(init, _get("$.session_id")).alias("agent"),
        F.when(init, F.coalesce(F.to_json(F.try_variant_get("event", "$.tools", "variant")), F.lit("[]"))).alias("tools"),
        F.when(kind == "result", _get("$.total_cost_usd", "double")).alias("cost"),
        F.coalesce((kind == "assistant") & F.exists(_blocks(), speaks), F.lit(False)).alias("sign_in"),
    )


def session_status(events: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """(session, agent_session, tools, needs_sign_in, busy, cost, events): where every session stands, from a finished table of events."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return session_facts(events, session, order).groupBy("session").agg(
        latest("agent").alias("agent_session"), F.from_json(F.coalesce(latest("tools"), F.lit("[]")), "array<string>").alias("tools"),
        F.bool_or("sign_in").alias("needs_sign_in"), (F.max_by("kind", "seq") != "result").alias("busy"), latest("cost").alias("cost"), F.count(F.lit(1)).alias("events"),
    )


def _milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


class Keyed(StatefulProcessor):
    """One value of state per key, and one timer: `quiet` after the last event the state goes and a last row comes."""

    state: str
    start: tuple

    def __init__(self, quiet: str = QUIET):
        self.quiet = _milliseconds(quiet)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.state)

    def absorb(self, s: dict, row: Row) -> None:
        raise NotImplementedError

    def told(self, key: tuple, s: dict, ended: bool) -> Iterator[Row]:
        raise NotImplementedError

    def _names(self) -> list[str]:
        return [field.split()[0] for field in self.state.split(", ")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Every call on state or timers is a message to the engine and back, so there are no more than needed.
        names, held = self._names(), self.value.get()
        s = dict(zip(names, self.start if held is None else held))
        before = s["last_at"]
        for row in rows:
            self.absorb(s, row)
            if row["ms"] is not None:
                s["last_at"] = max(s["last_at"], row["ms"])
        self.value.update(tuple(s[n] for n in names))
        if held is None or s["last_at"] != before:
            if held is not None:
                self.handle.deleteTimer(before + self.quiet)
            self.handle.registerTimer(s["last_at"] + self.quiet)
        yield from self.told(key, s, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.value.get()
        if held is not None:
            s = dict(zip(self._names(), held))
            self.value.clear()
            yield from self.told(key, s, True)

    def close(self) -> None:
        pass


class Sessions(Keyed):
    state = "agent string, agent_seq bigint, tools string, tools_seq bigint, sign_in boolean, kind string, kind_seq bigint, cost double, cost_seq bigint, events bigint, last_at bigint"
    start = (None, -1, "[]", -1, False, "", -1, None, -1, 0, 0)

    def absorb(self, s, row):
        s["events"] += 1
        s["sign_in"] = bool(s["sign_in"] or row["sign_in"])
        for name in ("agent", "tools", "kind", "cost"):
            if row[name] is not None and row["seq"] > s[f"{name}_seq"]:
                s[name], s[f"{name}_seq"] = row[name], row["seq"]

    def told(self, key, s, ended):
        yield Row(
            session=key[0], agent_session=s["agent"], tools=s["tools"], needs_sign_in=s["sign_in"], busy=s["kind"] != "result",
            cost=s["cost"], events=s["events"], ended=ended,
        )


def stream_sessions(events: DataFrame, session: str = "session", order: str = "seq", at: str = "at", lateness: str = LATENESS, quiet: str = QUIET) -> DataFrame:
    """`session_status` of a stream of parsed events, a row per session and batch that touches it, with `ended`: its state has been dropped."""
    facts = session_facts(events.withWatermark(at, lateness), session, order, at).filter(F.col("session").isNotNull() | F.col("at").isNull())
    key = facts.schema["session"].dataType.simpleString()
    out = f"session {key}, agent_session string, tools string, needs_sign_in boolean, busy boolean, cost double, events bigint, ended boolean"
    told = facts.withColumn("ms", F.unix_millis("at")).groupBy("session").transformWithState(Sessions(quiet), out, "Update", "EventTime")
    return told.withColumn("tools", F.from_json("tools", "array<string>"))


class Jobs(Keyed):
    """Steps of a job, each with its latest state; a job ends when all its announced steps have, or one has failed."""

    state = "steps string, last_at bigint"
    start = ("{}", 0)

    def absorb(self, s, row):
        steps = json.loads(s["steps"])
        step, seq, state = row["step"], row["seq"], row["state"]
        known = steps.get(step)
        steps[step] = [max(seq, known[0]) if known else seq, state if not known or seq > known[0] else known[1], (known[2] if known else 0) + 1]
        s["steps"] = json.dumps(steps)

    def told(self, key, s, ended):
        for step, (_, state, updates) in json.loads(s["steps"]).items():
            yield Row(job=key[0], step=step, state=state, updates=updates, ended=ended)


def stream_jobs(steps: DataFrame, at: str = "at", lateness: str = LATENESS, quiet: str = QUIET) -> DataFrame:
    """`events.job_progress` of a stream of step events (job, step, seq, state, at), with `ended`; a quiet job's state is dropped."""
    watched = steps.withWatermark(at, lateness).select("job", F.col("step").cast("string").alias("step"), F.col("seq").cast("bigint").alias("seq"), "state", F.col(at).alias("at"))
    watched = watched.filter(F.col("job").isNotNull() | F.col("at").isNull())
    key = watched.schema["job"].dataType.simpleString()
    return watched.withColumn("ms", F.unix_millis("at")).groupBy("job").transformWithState(Jobs(quiet), f"job {key}, step string, state string, updates bigint, ended boolean", "Update", "EventTime")


def replay_lateness(times: DataFrame, at: str = "at") -> str:
    """The span of the times of a finished table: files of it may come in any order and no row is late."""
    row = times.agg(F.unix_seconds(F.max(at)) - F.unix_seconds(F.min(at))).first()
    return f"{(row[0] or 0) + 1} seconds"
