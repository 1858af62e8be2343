"""Memory recall: meaning first, words for what meaning missed, within a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import memory
from .firstwins import nearest_known
from .fulltext import keyword_recall
from .fusion import budgeted, ordered_union


def semantic_leg(questions: DataFrame, facts: DataFrame, scenarios: DataFrame | None, limit: int) -> DataFrame:
    """(qid, leg 0, rank, key): the `limit * 2` closest facts and scenarios of each question."""
    pool = facts.select(F.concat(F.lit("L1:"), F.col("id").cast("string")).alias("id"), "embedding")
    if scenarios is not None and "embedding" in scenarios.columns:
        pool = pool.unionByName(scenarios.select(F.concat(F.lit("L2:"), "path").alias("id"), "embedding"))
    asked = questions.filter("embedding is not null").select(F.col("qid").alias("id"), "embedding")
    hits = nearest_known(asked, pool, threshold=-2.0, top=limit * 2)
    return hits.select(F.col("new_id").alias("qid"), F.lit(0).alias("leg"), "rank", F.col("id").alias("key"))


def candidates(
    questions: DataFrame,
    facts: DataFrame,
    scenarios: DataFrame | None = None,
    turns: DataFrame | None = None,
    limit: int = 8,
    include_superseded: bool = False,
) -> DataFrame:
    """(qid, leg, rank, key) in the order recall considers them, each key once.

    `questions` is (qid, text) with an optional `embedding`.
    """
    legs = keyword_recall(questions, facts, scenarios, turns, limit, include_superseded)
    if "embedding" in questions.columns and "embedding" in facts.columns:
        pool = facts if include_superseded else memory.live(facts)
        legs = semantic_leg(questions, pool, scenarios, limit).unionByName(legs)
    return ordered_union(legs)


def lines(facts: DataFrame, scenarios: DataFrame | None = None, turns: DataFrame | None = None) -> DataFrame:
    """(key, line, vec) of everything recall can show."""
    vec = F.col("embedding") if "embedding" in facts.columns else F.lit(None).cast("array<float>")
    if "verify_note" not in facts.columns:
        facts = facts.withColumn("verify_note", F.lit(None).cast("string"))
    out = facts.select(
        F.concat(F.lit("L1:"), F.col("id").cast("string")).alias("key"), memory.fact_line().alias("line"), vec.alias("vec")
    )
    if scenarios is not None:
        vec = F.col("embedding") if "embedding" in scenarios.columns else F.lit(None).cast("array<float>")
        out = out.unionByName(
            scenarios.select(F.concat(F.lit("L2:"), "path").alias("key"), memory.scenario_line().alias("line"), vec.alias("vec"))
        )
    if turns is not None:
        out = out.unionByName(
            turns.select(
                F.concat(F.lit("L0:"), F.col("id").cast("string")).alias("key"), memory.turn_line().alias("line"),
                F.lit(None).cast("array<float>").alias("vec"),
            )
        )
    return out


def recall(
    questions: DataFrame,
    facts: DataFrame,
    scenarios: DataFrame | None = None,
    turns: DataFrame | None = None,
    limit: int = 8,
    budget: int = 6000,
    redundant: float = 0.93,
    include_superseded: bool = False,
) -> DataFrame:
    """(qid, selected, used, duplicates, overflow) for a batch of questions.

    Only a candidate found by meaning carries its vector into the redundancy test.
    """
    # A few dozen keys per question, stored so that the planner knows their size.
    ordered = stored(candidates(questions, facts, scenarios, turns, limit, include_superseded))
    shown = lines(facts, scenarios, turns).select("key", F.length("line").alias("chars"), "vec")
    sized = shown.join(ordered, "key").withColumn("vec", F.when(F.col("leg") == 0, F.col("vec")))
    return budgeted(sized, limit, budget, redundant)
