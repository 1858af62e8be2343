"""Work items and their append-only event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .memory import live
from .ordering import top_per


def listing(tasks: DataFrame, state: str | None = "open", repo=None, limit: int = 20) -> DataFrame:
    """Most recently touched items; `state="all"` or None lifts the state filter."""
    if state and state != "all":
        tasks = tasks.filter(F.col("state") == state)
    if repo is not None:
        tasks = tasks.filter(F.col("repo") == F.lit(repo))
    return tasks.orderBy(F.col("updated_at").desc(), F.col("id").desc()).limit(limit)


def add_event(events: DataFrame, new: DataFrame) -> DataFrame:
    """Append events; an unknown kind is a note."""
    kind = F.when(F.col("kind").isin(fixed.TASK_KINDS), F.col("kind")).otherwise("note")
    return events.unionByName(new.withColumn("kind", kind), allowMissingColumns=True)


def touched(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks with `updated_at` moved to their latest event and `state` to their latest state event."""
    latest = events.groupBy("task_id").agg(
        F.max("at").alias("_at"),
        F.max_by("detail", F.when(F.col("kind") == "state", F.struct("at", "id"))).alias("_state"),
    )
    state = F.when(F.col("_state") == "opened", F.lit("open")).otherwise(F.col("_state"))
    return (
        tasks.join(latest, tasks["id"] == latest["task_id"], "left")
        .withColumn("updated_at", F.coalesce(F.greatest("updated_at", "_at"), "updated_at"))
        .withColumn("state", F.coalesce(state, "state"))
        .select(*tasks.columns)
    )


def resume(tasks: DataFrame, events: DataFrame, facts: DataFrame, last_events: int = 20, last_facts: int = 10):
    """Each task with its last events and the last live facts learned on it, both oldest first."""
    recent = top_per(events, ["task_id"], [F.col("at").desc(), F.col("id").desc()], last_events)
    history = recent.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "id", "kind", "detail"))).alias("events")
    )
    learned = top_per(live(facts).filter("task_id is not null"), ["task_id"], [F.col("id").desc()], last_facts)
    learned = learned.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "kind", "content"))).alias("facts")
    )
    keyed = tasks.withColumn("task_id", F.col("id"))
    return keyed.join(history, "task_id", "left").join(learned, "task_id", "left").drop("task_id")


def event_tail(events: DataFrame, last: int = 20) -> DataFrame:
    """The last events of every task, `rank` 1 being the newest."""
    return top_per(events, ["task_id"], [F.col("at").desc(), F.col("id").desc()], last)
