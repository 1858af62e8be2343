"""Usage metering: volumes, measured saving, daily totals, store counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Tools whose own input is what they replaced; every other tool is measured against its baseline.
INPUT_MEASURED = ("digest", "compress")


def by_tool(usage: DataFrame) -> DataFrame:
    return usage.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("in_chars").alias("in_chars"),
        F.sum("out_chars").alias("out_chars"),
        F.sum(F.coalesce("baseline_chars", F.lit(0))).alias("baseline_chars"),
    )


def daily(usage: DataFrame, days: int = 14) -> DataFrame:
    """Totals of the latest `days` days that saw any use."""
    return (
        usage.groupBy(F.to_date("at").alias("day"))
        .agg(
            F.sum("out_chars").alias("out_chars"),
            F.sum(F.coalesce("baseline_chars", F.lit(0))).alias("baseline_chars"),
            F.count(F.lit(1)).alias("calls"),
        )
        .orderBy(F.col("day").desc())
        .limit(days)
    )


def saving(input_measured: tuple[str, ...] = INPUT_MEASURED) -> Column:
    """Characters one tool kept out of the conversation, over its totals and never below zero."""
    consumed = F.when(F.col("tool").isin(*input_measured), F.col("in_chars")).otherwise(F.col("baseline_chars"))
    return F.greatest(consumed - F.col("out_chars"), F.lit(0))


def avoided(usage: DataFrame, input_measured: tuple[str, ...] = INPUT_MEASURED) -> DataFrame:
    return by_tool(usage).agg(F.coalesce(F.sum(saving(input_measured)), F.lit(0)).alias("avoided_chars"))


def report(usage: DataFrame, input_measured: tuple[str, ...] = INPUT_MEASURED) -> DataFrame:
    """Per tool: calls, estimated tokens in and out, and the measured reduction where one is known."""
    base = F.when(F.col("tool").isin(*input_measured), F.greatest("in_chars", F.lit(1))).otherwise(
        F.col("baseline_chars")
    )
    return by_tool(usage).select(
        "tool",
        "calls",
        tx.estimated_tokens("in_chars").alias("in_tokens"),
        tx.estimated_tokens("out_chars").alias("out_tokens"),
        tx.estimated_tokens("baseline_chars").alias("baseline_tokens"),
        tx.percent_smaller(F.col("out_chars"), base).alias("smaller_pct"),
    )


def store_counts(facts: DataFrame, turns: DataFrame, tasks: DataFrame, pending: DataFrame) -> DataFrame:
    """How much each layer of the store holds, as (layer, rows)."""

    def tally(df: DataFrame, layer: str, keep: Column) -> DataFrame:
        return df.agg(F.count_if(keep).alias("rows")).select(F.lit(layer).alias("layer"), "rows")

    return (
        tally(facts, "facts", F.col("superseded_by").isNull())
        .unionByName(tally(turns, "turns", F.lit(True)))
        .unionByName(tally(tasks, "open_tasks", F.col("state") == "open"))
        .unionByName(tally(pending, "pending", F.col("state") == "pending"))
    )
