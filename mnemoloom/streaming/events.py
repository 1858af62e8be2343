"""Streams of session events, usage and job progress.

Each function takes a streaming or a plain DataFrame: the same definition serves both.
State is bounded by a watermark, one day unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import memory

LATENESS = "1 day"


# Sources --------------------------------------------------------------------
def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A folder growing newline-delimited files, as a stream of lines."""
    return spark.readStream.text(folder)


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add `event` (variant), null where a line is not JSON; the line itself is kept for the raw view."""
    raw = tx.ellipsis(value, 2000)
    return lines.filter(F.trim(value) != "").withColumn("raw", raw).withColumn("event", F.try_parse_json(value))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("event", path, kind)


# Turns ----------------------------------------------------------------------
def _blocks() -> Column:
    content = F.to_json(F.try_variant_get("event", "$.message.content", "variant"))
    block = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
    return F.from_json(content, block)


def input_summary(name: Column, payload: Column) -> Column:
    """What a tool call is doing, in one line."""
    field = lambda k: F.coalesce(F.get_json_object(payload, f"$.{k}"), F.lit(""))
    slashed = lambda c: F.translate(c, "\\", "/")
    out = tx.ellipsis(F.coalesce(payload, F.lit("")), 200)
    for tool, key in fixed.TOOL_FIELDS.items():
        told = slashed(field(key)) if key in fixed.TOOL_PATHS else field(key)
        if tool == fixed.TOOL_PLACED:
            place = field(fixed.TOOL_PLACE)
            told = F.concat(told, F.when(place != "", F.concat(F.lit(" in "), slashed(place))).otherwise(""))
        out = F.when(name == tool, told).otherwise(out)
    return out


def _result_text(content: Column) -> Column:
    """A tool result's text: a string as it is, a list of blocks joined by lines."""
    blocks = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return F.when(F.coalesce(content, F.lit("")).rlike(r"^\s*\[\s*\{"), joined).otherwise(F.coalesce(content, F.lit("")))


def turns(events: DataFrame, session: str = "session") -> DataFrame:
    """(session, role, call_id, name, text, plus pass-through columns): what each event says.

    Roles are assistant, tool, result (the outcome of a call) and notice.
    """
    kept = [c for c in events.columns if c not in ("value", "raw", "event")]
    kind = _get("$.type")
    said = events.withColumn("_type", kind).withColumn("_sub", _get("$.subtype")).withColumn("_blocks", _blocks())
    empty = F.lit(None).cast("string")

    def shape(b: Column) -> Column:
        return F.struct(
            F.when(b["type"] == "text", "assistant").when(b["type"] == "tool_use", "tool").otherwise("result").alias("role"),
            F.when(b["type"] == "tool_use", b["id"]).when(b["type"] == "tool_result", b["tool_use_id"]).alias("call_id"),
            F.when(b["type"] == "tool_use", b["name"]).alias("name"),
            F.when(b["type"] == "text", b["text"])
            .when(b["type"] == "tool_use", input_summary(b["name"], b["input"]))
            .otherwise(tx.clip_with_remainder(_result_text(b["content"]))).alias("text"),
            F.coalesce(b["is_error"], F.lit(False)).alias("failed"),
        )

    speaks = lambda b: ((F.col("_type") == "assistant") & (((b["type"] == "text") & (F.trim(b["text"]) != "")) | (b["type"] == "tool_use"))) | (
        (F.col("_type") == "user") & (b["type"] == "tool_result")
    )
    blocks = F.transform(F.filter(F.coalesce("_blocks", F.array().cast(_EMPTY)), speaks), shape)
    stopped = (F.col("_type") == "result") & F.col("_sub").isNotNull() & (F.col("_sub") != "success")
    notice = F.array(
        F.struct(
            F.lit("notice").alias("role"), empty.alias("call_id"), empty.alias("name"),
            F.concat(F.lit(fixed.STOPPED), F.col("_sub")).alias("text"), F.lit(False).alias("failed"),
        )
    )
    rows = F.when(stopped, notice).otherwise(blocks)
    return said.select(*kept, F.posexplode(rows).alias("position", "_t")).select(*kept, "position", "_t.*")


_EMPTY = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def session_state(events: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """(session, agent_session, busy, cost, events): where each session stands. Streams in update mode."""
    kind = _get("$.type")
    order_col = F.col(order)
    return events.filter("event is not null").groupBy(session).agg(
        F.max_by(_get("$.session_id"), F.when((kind == "system") & (_get("$.subtype") == "init"), order_col)).alias("agent_session"),
        (F.max_by(kind, order_col) != "result").alias("busy"),
        F.max_by(_get("$.total_cost_usd", "double"), F.when(_get("$.total_cost_usd", "double").isNotNull(), order_col)).alias("cost"),
        F.count(F.lit(1)).alias("events"),
    )


# Pairing --------------------------------------------------------------------
def pair_calls(tool_events: DataFrame) -> DataFrame:
    """(session_id, call_id, called, answered, chars, state) per tool call, whatever order its two halves come in.

    `tool_events` is (session_id, seq, kind, call_id, chars[, failed]). Results nobody
    asked for have no row. Each call is its own group, so pairing spreads evenly.
    """
    use, result = F.col("kind") == "tool_use", F.col("kind") == "tool_result"
    failed = F.col("failed") if "failed" in tool_events.columns else F.lit(False)
    out = tool_events.groupBy("session_id", "call_id").agg(
        F.max(F.when(use, F.col("seq"))).alias("called"), F.max(F.when(result, F.col("seq"))).alias("answered"),
        F.max_by("chars", F.when(result, F.col("seq"))).alias("chars"),
        F.max_by(failed, F.when(result, F.col("seq"))).alias("_failed"),
    )
    state = F.when(F.col("answered").isNull(), "running").when(F.col("_failed"), "failed").otherwise("done")
    return out.filter("called is not null").select("session_id", "call_id", "called", "answered", "chars", state.alias("state"))


def join_calls(calls: DataFrame, results: DataFrame, at: str = "at", lateness: str = LATENESS) -> DataFrame:
    """The same pairing as a stream-stream left join: a call waits one `lateness` for its result.

    Both sides need (session_id, call_id, at); unanswered calls come out with nulls
    once the watermark has passed them.
    """
    return _joined(calls.withWatermark(at, lateness), results.withWatermark(at, lateness), at, lateness)


def paired_stream(events: DataFrame, same_events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(session, call_id, called, answered, chars, state) of a stream of parsed events, which has to be given twice.

    A result that comes before its call in the files waits for it; a call without one is `running` once the watermark
    has passed the time in which its result could come. Results nobody asked for, and those of another session, are left out.
    """
    # The join drops rows without a session, which must not happen before their time has moved the watermark: so a session depends on it.
    session = F.when(F.col("at").isNotNull(), F.col("session"))
    timed = lambda e: e.withWatermark("at", lateness).withColumn("session", session)
    calls = turns(timed(events)).filter((F.col("role") == "tool") | F.col("at").isNull())
    calls = calls.select(F.col("session").alias("session_id"), "call_id", "at", F.col("seq").alias("called"))
    results = turns(timed(same_events)).filter((F.col("role") == "result") | F.col("at").isNull())
    results = results.select(F.col("session").alias("session_id"), "call_id", "at", F.col("seq").alias("answered"), F.length("text").cast("bigint").alias("chars"), "failed")
    state = F.when(F.col("r.call_id").isNull(), "running").when(F.col("r.failed"), "failed").otherwise("done")
    return _joined(calls, results, "at", LATENESS).select(F.col("c.session_id").alias("session"), F.col("c.call_id").alias("call_id"), "called", "answered", "chars", state.alias("state"))


def _joined(calls: DataFrame, results: DataFrame, at: str, wait: str) -> DataFrame:
    c, r = calls.alias("c"), results.alias("r")
    within = F.expr(f"r.call_id = c.call_id and r.session_id = c.session_id and r.{at} between c.{at} - interval {wait} and c.{at} + interval {wait}")
    return c.join(r, within, "left")


# Usage ----------------------------------------------------------------------
def daily_usage(usage: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(day, tool, calls, out_chars): tumbling days. Late rows within `lateness` still count."""
    watched = usage.withWatermark("at", lateness) if usage.isStreaming else usage
    return (
        watched.groupBy(F.window("at", "1 day"), "tool")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("out_chars").alias("out_chars"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tool", "calls", "out_chars")
    )


def active_periods(usage: DataFrame, by: list[str], idle: str = "15 minutes", lateness: str = LATENESS) -> DataFrame:
    """(*by, started, ended, calls): stretches of use with no pause as long as `idle`."""
    watched = usage.withWatermark("at", lateness) if usage.isStreaming else usage
    return (
        watched.groupBy(F.session_window("at", idle), *by)
        .agg(F.count(F.lit(1)).alias("calls"), F.max("at").alias("ended"))
        .select(*by, F.col("session_window.start").alias("started"), "ended", "calls")
    )


# Jobs -----------------------------------------------------------------------
def job_progress(steps: DataFrame) -> DataFrame:
    """(job, step, state, updates) from step events (job, step, seq, state): the latest state of every step."""
    return steps.groupBy("job", "step").agg(F.max_by("state", "seq").alias("state"), F.count(F.lit(1)).alias("updates"))


def job_state(progress: DataFrame) -> DataFrame:
    """(job, state): failed once a step failed, running while any waits or runs, else done."""
    return progress.groupBy("job").agg(
        F.when(F.bool_or(F.col("state") == "failed"), "failed")
        .when(F.bool_or(F.col("state").isin("waiting", "running")), "running")
        .otherwise("done").alias("state")
    )


# Capture --------------------------------------------------------------------
def capture_turns(turns_stream: DataFrame, table: str, checkpoint: str, max_chars: int = 4000):
    """Redact and append each batch of turns to a parquet folder; a retried batch replaces itself.

    Retention is maintenance on that folder (`operators.memory.prune`), not part of the stream.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        memory.capture(batch, max_chars).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return turns_stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(land).start()
