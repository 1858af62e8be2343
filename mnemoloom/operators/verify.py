"""Checking the parts of a fact a machine can check: the paths it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .memory import live


def claims(text: Column | str) -> Column:
    """Distinct paths a text names, Windows ones first."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.coalesce(t, F.lit(""))
    found = F.concat(
        F.regexp_extract_all(t, F.lit(fixed.WINDOWS_PATH), F.lit(0)),
        F.regexp_extract_all(t, F.lit(fixed.POSIX_PATH), F.lit(1)),
    )
    trimmed = F.transform(found, lambda p: F.regexp_replace(p, fixed.CLAIM_TRAILING, ""))
    segments = lambda p: F.size(F.filter(F.split(p, r"[\\/]+"), lambda s: s != ""))
    good = F.filter(
        trimmed,
        lambda p: (F.length(p) >= 4)
        & ~p.rlike(fixed.CLAIM_PLACEHOLDER)
        & ~p.rlike(fixed.CLAIM_URL)
        & (segments(p) >= 2),
    )
    return F.array_distinct(good)


def resolved(claim: Column, home: str = "/root") -> Column:
    p = F.translate(claim, "\\", "/")
    return F.when((p == "~") | p.startswith("~/"), F.concat(F.lit(home.rstrip("/")), F.substring(p, F.lit(2), F.length(p)))).otherwise(p)


def checked_claims(facts: DataFrame, paths: DataFrame, home: str = "/root") -> DataFrame:
    """(id, position, claim, exists) of every claim that could be a path here.

    `paths` (path) is the inventory of what exists. A claim counts only when its root
    exists, or is a drive letter: a route reads like a path, but nothing holds it.
    """
    named = facts.select("id", F.posexplode(claims("content")).alias("position", "claim"))
    named = named.withColumn("_full", resolved(F.col("claim"), home))
    named = named.withColumn("_root", F.get(F.filter(F.split("_full", "/"), lambda s: s != ""), F.lit(0)))
    roots = paths.select(F.get(F.filter(F.split("path", "/"), lambda s: s != ""), F.lit(0)).alias("_root")).distinct()
    rooted = named.join(roots.withColumn("_known", F.lit(True)), "_root", "left")
    plausible = rooted.filter(F.col("_known") | F.col("_root").rlike("^[A-Za-z]:$"))
    there = paths.select(F.col("path").alias("_full")).distinct().withColumn("_there", F.lit(True))
    return plausible.join(there, "_full", "left").select("id", "position", "claim", F.coalesce("_there", F.lit(False)).alias("exists"))


def verdicts(facts: DataFrame, paths: DataFrame, home: str = "/root") -> DataFrame:
    """(id, verify_state, verify_note): ok, stale, or unknown where there was nothing to check."""
    per_fact = checked_claims(facts, paths, home).groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_list(F.when(~F.col("exists"), F.struct("position", "claim")))).alias("_missing"),
    )
    lost = F.size("_missing")
    shown = F.array_join(F.transform(F.slice("_missing", 1, 2), lambda m: m["claim"]), ", ")
    more = F.when(lost > 2, F.concat(F.lit(" (+"), (lost - 2).cast("string"), F.lit(" more)"))).otherwise("")
    state = F.when(F.col("_n").isNull(), "unknown").when(lost == 0, "ok").otherwise("stale")
    note = (
        F.when(F.col("_n").isNull(), "names no path")
        .when(lost == 0, F.concat(F.col("_n").cast("string"), F.lit(" paths found")))
        .otherwise(F.concat(F.lit("not found: "), shown, more))
    )
    return facts.select("id").join(per_fact, "id", "left").select("id", state.alias("verify_state"), note.alias("verify_note"))


def reverify(facts: DataFrame, paths: DataFrame, home: str = "/root") -> DataFrame:
    """Facts with the outcome of checking every live one again."""
    fresh = verdicts(live(facts), paths, home).select(
        "id", F.col("verify_state").alias("_state"), F.col("verify_note").alias("_note")
    )
    out = facts.join(fresh, "id", "left").withColumn("verify_state", F.coalesce("_state", "verify_state"))
    if "verify_note" in facts.columns:
        out = out.withColumn("verify_note", F.coalesce("_note", "verify_note"))
    if "verified_at" in facts.columns:
        out = out.withColumn("verified_at", F.when(F.col("_state").isNotNull(), F.current_timestamp()).otherwise(F.col("verified_at")))
    return out.select(*facts.columns)


def drifted(facts: DataFrame, paths: DataFrame, limit: int = 3, home: str = "/root") -> DataFrame:
    """The first facts naming paths that are gone, each with the total."""
    stale = verdicts(live(facts), paths, home).filter("verify_state = 'stale'")
    total = stale.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stale.orderBy("id").limit(limit).withColumn("total", total)


def save_facts(facts: DataFrame, new: DataFrame, paths: DataFrame, home: str = "/root") -> DataFrame:
    """Append facts (kind, content, context, priority, ...) under new ids, checked as they are written.

    A fact naming a path that is gone is stored as stale from its first day.
    """
    from .ordering import dense_index

    top = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = dense_index(new.drop("id") if "id" in new.columns else new, "content", "_n").withColumn("id", top + F.col("_n")).drop("_n")
    checked = numbered.drop("verify_state", "verify_note").join(verdicts(numbered, paths, home), "id")
    return facts.unionByName(checked, allowMissingColumns=True)
