"""Streams with state: equal to the batch answer whatever order the files come in, and empty afterwards."""

import json

import pytest
from pyspark.sql import functions as F

from mnemoloom.streaming import events as ev
from mnemoloom.streaming import stateful as sf
from mnemoloom.streaming.runner import drain, replayed, run_available

SCHEMA = "session string, seq bigint, at timestamp, line string"


def lines():
    talk = [
        {"type": "system", "subtype": "init", "session_id": "old", "tools": ["Read"]},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "Hello."}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "a"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "late"}]}},
        {"type": "system", "subtype": "init", "session_id": "new", "tools": ["Read", "Bash"]},
        {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "nobody", "content": "x"}]}},
        {"type": "result", "subtype": "success", "total_cost_usd": 0.25},
        {"type": "noise"},
        {"type": "result", "subtype": "error", "total_cost_usd": 0.5},
    ]
    rows = [("a", k, f"2024-01-01 00:{k:02d}:00", json.dumps(e)) for k, e in enumerate(talk)]
    rows += [("b", 0, "2024-01-01 05:00:00", json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "Please run /claude login"}]}}))]
    rows += [("c", 0, "2024-01-01 06:00:00", "not json"), ("c", 1, "2024-01-01 06:01:00", json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": " "}]}}))]
    return rows


def parsed(df):
    return df.withColumn("event", F.try_parse_json(F.coalesce("line", F.lit("null"))))


def table(spark):
    return spark.createDataFrame(lines(), "session string, seq bigint, at string, line string").withColumn("at", F.to_timestamp("at"))


def stream(spark, files):
    return parsed(replayed(table(spark), files).select(F.from_json("value", SCHEMA).alias("e")).select("e.*"))


@pytest.mark.parametrize("files", [1, 5])
def test_sessions(spark, files):
    batch = {r.session: r.asDict() for r in sf.session_status(parsed(table(spark))).collect()}
    assert batch["a"] == {"session": "a", "agent_session": "new", "tools": ["Read", "Bash"], "needs_sign_in": False, "busy": False, "cost": 0.5, "events": 9}
    assert batch["b"]["needs_sign_in"] and batch["b"]["busy"] and batch["b"]["tools"] == [] and batch["b"]["cost"] is None and batch["c"]["events"] == 1
    told = run_available(sf.stream_sessions(stream(spark, files), lateness="1 day"), ["session"]).collect()
    assert {r.session: {k: v for k, v in r.asDict().items() if k != "ended"} for r in told} == batch and all(r.ended for r in told)


def test_state_is_dropped_and_starts_anew(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def feed(name, rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("session", "seq", "at", "line"), r))) + "\n" for r in rows))
        events = parsed(ev.read_lines(spark, src).select(F.from_json("value", SCHEMA).alias("e")).select("e.*"))
        query = drain(sf.stream_sessions(events, lateness="1 hour", quiet="2 hours"), out, state)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    done = json.dumps({"type": "result", "total_cost_usd": 1.0})
    assert feed("1", [("s", 0, "2024-01-01T00:00:00Z", done)]) > 0
    feed("2", [("t", 0, "2024-01-05T00:00:00Z", done)])
    feed("3", [("t", 1, "2024-01-05T00:01:00Z", done)])
    feed("4", [("s", 7, "2024-01-05T00:02:00Z", json.dumps({"type": "assistant"}))])
    rows = spark.read.parquet(out).filter("session = 's'").orderBy("batch").collect()
    assert [(r.events, r.ended, r.busy) for r in rows] == [(1, False, False), (1, True, False), (1, False, True)]


@pytest.mark.parametrize("files", [1, 4])
def test_pairs_over_unordered_files(spark, files):
    got = run_available(ev.paired_stream(stream(spark, files), stream(spark, files), "1 day"), ["session"], mode="append").collect()
    assert sorted(tuple(r) for r in got) == [("a", "t1", 1, 2, 4, "done"), ("a", "t2", 4, None, None, "running")]


def test_jobs_end_and_leave_no_state(spark):
    rows = [(1, "build", 1, "running", 0), (1, "build", 5, "done", 40), (1, "test", 2, "waiting", 1), (1, "test", 9, "failed", 90), (2, "build", 3, "running", 3)]
    steps = spark.createDataFrame(rows, "job bigint, step string, seq bigint, state string, m int").select("job", "step", "seq", "state", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60).alias("at"))
    for files in (1, 5):
        read = replayed(steps, files).select(F.from_json("value", "job bigint, step string, seq bigint, state string, at timestamp").alias("s")).select("s.*")
        got = run_available(sf.stream_jobs(read, lateness=sf.replay_lateness(steps)), ["job", "step"]).collect()
        assert sorted(tuple(r) for r in got) == [(1, "build", "done", 2, True), (1, "test", "failed", 2, True), (2, "build", "running", 1, True)]


def test_days_of_unordered_files_are_all_counted(spark):
    usage = spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00", t, d) for d in range(1, 29) for t in ("view", "click")], "at string, tool string, out_chars bigint").withColumn("at", F.to_timestamp("at"))
    read = replayed(usage, 7).select(F.from_json("value", "at timestamp, tool string, out_chars bigint").alias("u")).select("u.*")
    got = run_available(ev.daily_usage(read, sf.replay_lateness(usage)), ["day", "tool"]).filter("tool is not null")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in ev.daily_usage(usage).collect())
