"""Streams over the event and conversation tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..sources import views as v
from ..streaming import events as ev
from ..streaming import stateful as sf
from ..streaming.runner import replayed, run_available
from .registry import query


@query(
    "usage",
    """SELECT strftime("at", '%Y-%m-%d') AS day, tool, count(*) AS calls, CAST(sum(out_chars) AS BIGINT) AS out_chars
       FROM usage GROUP BY ALL""",
)
def usage_window_stream(spark, path):
    """Daily usage as a stream over unordered files, late by their span at most."""
    usage = v.usage(spark, path).select("at", "tool", "out_chars")
    read = replayed(usage).select(F.from_json("value", "at timestamp, tool string, out_chars bigint").alias("u")).select("u.*")
    return run_available(ev.daily_usage(read, sf.replay_lateness(usage)), ["day", "tool"]).filter("tool is not null")


def _replayed_events(spark, path):
    """Protocol events as a stream of lines from unordered files, parsed, with the lateness that their disorder needs."""
    events = v.session_events(spark, path)
    lines = replayed(events)
    read = lines.select(F.from_json("value", "session bigint, seq bigint, at timestamp, line string").alias("e")).select("e.*")
    # The line that ends the replay says nothing; it has to reach the watermark.
    parsed = read.withColumn("event", F.try_parse_json(F.coalesce("line", F.lit("null"))))
    return parsed, sf.replay_lateness(events)


_STATUS = f"""
    SELECT session, max('agent-' || session) FILTER (kind = 'system') AS agent_session,
           CASE WHEN count(*) FILTER (kind = 'system') = 0 THEN '' WHEN session % 2 = 0 THEN 'Read,Bash' ELSE 'Read' END AS tools,
           bool_or(kind = 'assistant' AND ((session + seq) % 7 = 0 OR regexp_matches(text, '{fixed.NEEDS_SIGN_IN}'))) AS needs_sign_in,
           arg_max(kind, seq) <> 'result' AS busy, CAST(max(seq) FILTER (kind = 'result') AS DOUBLE) / 8 AS cost, count(*) AS events"""


@query("session_rows", f"{_STATUS} FROM session_rows GROUP BY session")
def session_status(spark, path):
    """Where every session stands, from a table of its events."""
    events = v.session_events(spark, path).withColumn("event", F.try_parse_json("line"))
    return sf.session_status(events).withColumn("tools", F.array_join("tools", ","))


@query("session_rows", f"{_STATUS}, true AS ended FROM session_rows GROUP BY session")
def session_status_stream(spark, path):
    """The same kept up by a stream over unordered files, until every session's state has been dropped."""
    events, lateness = _replayed_events(spark, path)
    return run_available(sf.stream_sessions(events, lateness=lateness), ["session"]).withColumn("tools", F.array_join("tools", ","))


@query(
    "session_rows",
    """SELECT c.session, 'c' || c.seq AS call_id, c.seq AS called, r.seq AS answered, CAST(length(r.text) AS BIGINT) AS chars,
              CASE WHEN r.seq IS NULL THEN 'running' WHEN r.seq % 5 = 0 THEN 'failed' ELSE 'done' END AS state
       FROM session_rows c LEFT JOIN session_rows r ON r.session = c.session AND r.kind = 'user' AND r.seq = c.seq + 1
       WHERE c.kind = 'assistant'""",
)
def session_pairing_stream(spark, path):
    """Tool calls and their results joined while both come in; a call nobody answers comes out when its time is over."""
    events, lateness = _replayed_events(spark, path)
    # Two scans of the files, as a stream is not read twice by one join.
    again, _ = _replayed_events(spark, path)
    return run_available(ev.paired_stream(events, again, lateness), ["session", "call_id"], mode="append")


_PERIODS = """
    gaps AS (SELECT user_id, "at", CASE WHEN "at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at") < INTERVAL 15 MINUTE
                                        THEN 0 ELSE 1 END AS fresh FROM usage),
    marked AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
    SELECT user_id, strftime(min("at"), '%Y-%m-%d %H:%M:%S') AS started, strftime(max("at"), '%Y-%m-%d %H:%M:%S') AS ended,
           count(*) AS calls FROM marked GROUP BY user_id, s"""


def _readable(df):
    stamp = "yyyy-MM-dd HH:mm:ss"
    return df.withColumn("started", F.date_format("started", stamp)).withColumn("ended", F.date_format("ended", stamp))


@query("usage", f", {_PERIODS}")
def usage_sessions(spark, path):
    """Active periods per user, ended by fifteen idle minutes."""
    return _readable(ev.active_periods(v.usage(spark, path), ["user_id"]))


_PAIRED = """
    SELECT session_id, call_id, max(seq) FILTER (kind = 'tool_use') AS called, max(seq) FILTER (kind = 'tool_result') AS answered,
           arg_max(chars, seq) FILTER (kind = 'tool_result') AS chars,
           CASE WHEN count(*) FILTER (kind = 'tool_result') = 0 THEN 'running' ELSE 'done' END AS state
    FROM tool_events GROUP BY session_id, call_id HAVING count(*) FILTER (kind = 'tool_use') > 0"""


@query("tool_events", _PAIRED)
def session_pairing(spark, path):
    return ev.pair_calls(v.tool_events(spark, path))


@query(
    "task_events",
    """SELECT task_id AS job, kind AS step, arg_max(CASE WHEN detail LIKE '%1%' THEN 'done' ELSE 'running' END, id) AS state,
              count(*) AS updates FROM task_events GROUP BY ALL""",
)
def job_progress_stream(spark, path):
    """The latest state of each step of each job, kept up by a stream over unordered files that drops the state of quiet jobs."""
    state = F.when(F.col("props").contains("1"), "done").otherwise("running")
    steps = v.table(spark, path, "events").select(
        F.col("user_id").alias("job"), F.col("event_type").alias("step"), F.col("event_id").alias("seq"), state.alias("state"), F.col("ts").cast("timestamp").alias("at")
    )
    read = replayed(steps).select(F.from_json("value", "job bigint, step string, seq bigint, state string, at timestamp").alias("s")).select("s.*")
    told = run_available(sf.stream_jobs(read, lateness=sf.replay_lateness(steps)), ["job", "step"])
    return told.filter("ended").drop("ended")


@query(
    "turns",
    """SELECT session_id AS session, count(*) AS events, arg_max(role, id) <> 'assistant' AS busy FROM turns GROUP BY session_id""",
)
def session_state(spark, path):
    """Conversations replayed as protocol events: an assistant turn closes what a user turn opened."""
    kind = F.when(F.col("role") == "assistant", "result").otherwise(F.col("role"))
    lines = v.turns(spark, path).select(
        F.col("session_id").alias("session"), F.col("id").alias("seq"),
        F.to_json(F.struct(kind.alias("type"), F.struct(F.col("content").alias("content")).alias("message"))).alias("value"),
    )
    return ev.session_state(ev.parse(lines)).select("session", "events", "busy")


@query(
    "turns",
    """SELECT session_id AS session, id AS seq, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'result' END AS role,
              CASE WHEN role = 'user' AND length(content) > 1200
                   THEN 1200 + length(chr(10) || '… ' || (length(content) - 1200) || ' more characters') ELSE length(content) END AS chars
       FROM turns WHERE role IN ('assistant', 'user')""",
)
def session_turns(spark, path):
    """Conversation turns as protocol blocks: assistant text, and user turns as tool results."""
    block = F.struct(
        F.when(F.col("role") == "user", "tool_result").otherwise("text").alias("type"),
        F.when(F.col("role") != "user", F.col("content")).alias("text"), F.lit("c").alias("tool_use_id"),
        F.when(F.col("role") == "user", F.col("content")).alias("content"),
    )
    lines = v.turns(spark, path).select(
        F.col("session_id").alias("session"), F.col("id").alias("seq"),
        F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(block).alias("content")).alias("message"))).alias("value"),
    )
    out = ev.turns(ev.parse(lines))
    return out.select("session", "seq", "role", F.length("text").cast("bigint").alias("chars"))
