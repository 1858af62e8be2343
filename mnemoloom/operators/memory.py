"""Facts, turns, scenarios and proposals: reading them and moving them through their life cycle.

Every mutation is a function from tables to tables; `sources.snapshots` writes the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions import vectors as vx
from .firstwins import first_of_each, keep_first_wins


# Reading --------------------------------------------------------------------
def live(facts: DataFrame) -> DataFrame:
    """Facts nothing has replaced."""
    return facts.filter(F.col("superseded_by").isNull())


def not_stale() -> Column:
    """Null-safe: a fact that was never checked passes."""
    return ~F.col("verify_state").eqNullSafe("stale")


def search_like(facts: DataFrame, text: str, limit: int = 60) -> DataFrame:
    """Newest live facts containing `text`; % and _ in it are wildcards."""
    hits = live(facts)
    if text.strip():
        hits = hits.filter(F.col("content").ilike(f"%{text.strip()}%"))
    return hits.orderBy(F.col("id").desc()).limit(limit)


def list_prefix(scenarios: DataFrame, prefix: str = "") -> DataFrame:
    return scenarios.filter(F.col("path").startswith(prefix)).orderBy("path")


def recent(facts: DataFrame, limit: int = 6) -> DataFrame:
    return live(facts).filter(not_stale()).orderBy(F.col("priority").desc(), F.col("id").desc()).limit(limit)


def verify_tally(facts: DataFrame) -> DataFrame:
    return live(facts).groupBy("verify_state").agg(F.count(F.lit(1)).alias("facts"))


def fact_line() -> Column:
    """How recall shows a fact. Its length is what the character budget counts."""
    stale = F.when(F.col("verify_state") == "stale", F.concat(F.lit(" !stale: "), F.coalesce("verify_note", F.lit(""))))
    at = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(" @"), "context"))
    return F.concat(
        F.lit("[L1:"), F.col("id").cast("string"), F.lit("] ("), "kind",
        F.coalesce(at, F.lit("")), F.coalesce(stale, F.lit("")), F.lit(") "), "content",
    )


def scenario_line() -> Column:
    at = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" @"), "summary"))
    return F.concat(
        F.lit("[L2:"), "path", F.lit("] (scenario"), F.coalesce(at, F.lit("")), F.lit(") "),
        F.substring("content", 1, 1200),
    )


def turn_line() -> Column:
    return F.concat(
        F.lit("[L0:"), F.col("id").cast("string"), F.lit("] ("), "role", F.lit(" @"),
        F.col("session_id").cast("string"), F.lit(") "), "content",
    )


# Facts ----------------------------------------------------------------------
def supersede(facts: DataFrame, new_id, old_ids: DataFrame, at: Column | None = None) -> DataFrame:
    """Mark old facts as replaced; one already replaced keeps its first replacement.

    `old_ids` is a table with a column `id`. Nothing changes when `new_id` does not exist.
    """
    known = facts.filter(F.col("id") == F.lit(new_id)).agg((F.count(F.lit(1)) > 0).alias("k")).scalar()
    marked = old_ids.select("id").distinct().withColumn("_hit", known)
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("superseded_by").isNull() & (F.col("id") != F.lit(new_id))
    out = facts.join(marked.select("id", "_hit"), "id", "left")
    out = out.withColumn("_hit", hit)
    if "superseded_at" in facts.columns:
        out = out.withColumn(
            "superseded_at", F.when(F.col("_hit"), at or F.current_timestamp()).otherwise(F.col("superseded_at"))
        )
    out = out.withColumn("superseded_by", F.when(F.col("_hit"), F.lit(new_id)).otherwise(F.col("superseded_by")))
    return out.select(*facts.columns)


def supersede_candidates(
    facts: DataFrame, new: DataFrame, threshold: float = 0.86, top: int = 3
) -> DataFrame:
    """Live facts a new one may replace. `new` holds exactly one fact (id, embedding).

    The new vector is a scalar subquery, so this is one scan of the facts with a
    dot product per row: no join and no shuffle but the top-k.
    """
    vec = new.select("embedding").scalar()
    own = new.select("id").scalar()
    return (
        facts.filter(F.col("embedding").isNotNull() & (F.col("id") != own))
        .withColumn("_asked", vec)
        .withColumn("score", vx.dot("embedding", "_asked"))
        .drop("_asked")
        .filter(F.col("score") >= threshold)
        .orderBy(F.col("score").desc(), "id")
        .limit(top)
    )


def novel(
    incoming: DataFrame,
    known: DataFrame,
    threshold: float = 0.88,
    order: str = "id",
) -> DataFrame:
    """Incoming texts that say something new: not known already and not said earlier in the batch.

    Compared by flattened text; where both tables carry an `embedding`, also by
    similarity to anything known or already kept. Both comparisons are exact.
    """
    keyed = incoming.withColumn("_flat", tx.flat_key("content"))
    seen = known.select(tx.flat_key("content").alias("_flat")).distinct()
    fresh = first_of_each(keyed.join(seen, "_flat", "left_anti"), ["_flat"], order).drop("_flat")
    if "embedding" in incoming.columns and "embedding" in known.columns:
        fresh = keep_first_wins(fresh, known, threshold, order)
    return fresh


def merge_facts(mine: DataFrame, bundle: DataFrame, threshold: float = 0.88) -> DataFrame:
    """Live facts of a bundle this store does not have yet."""
    return novel(live(bundle), live(mine), threshold)


def new_proposals(proposals: DataFrame, pending: DataFrame, facts: DataFrame, threshold: float = 0.88) -> DataFrame:
    """Proposals minus the ones already waiting or already known."""
    columns = [c for c in ("content", "embedding") if all(c in d.columns for d in (pending, facts))]
    known = pending.filter(F.col("state") == "pending").select(*columns).unionByName(live(facts).select(*columns))
    return novel(proposals, known, threshold)


# Proposals ------------------------------------------------------------------
def parse_proposals(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Candidate facts named by a model's reply, at most four per reply, by position.

    A line is one candidate: its list mark goes, a leading kind becomes a column, and what is left must be
    long enough to say something. A reply that begins with NONE names nothing.
    """
    rest = [c for c in replies.columns if c != reply]
    split = replies.filter(~F.col(reply).rlike(fixed.PROPOSAL_NONE)).withColumn("_lines", F.split(reply, r"\r?\n"))
    kind = F.nullif(F.lower(F.regexp_extract("_bare", fixed.PROPOSAL_KIND, 1)), F.lit(""))
    said = F.when(kind.isNull(), F.col("_bare")).otherwise(F.trim(F.regexp_extract("_bare", fixed.PROPOSAL_KIND, 2)))
    named = (
        split.select(*rest, F.col("_lines"))
        .withColumn("_kept", F.transform("_lines", lambda line: F.regexp_replace(F.trim(line), fixed.PROPOSAL_MARK, "")))
        .withColumn("_kept", F.filter("_kept", lambda b: (F.length(b) >= fixed.PROPOSAL_LEAST) & (F.length(F.trim(F.regexp_replace(b, fixed.PROPOSAL_KIND, "$2"))) >= fixed.PROPOSAL_LEAST)))
        .select(*rest, F.posexplode(F.slice("_kept", 1, fixed.PROPOSALS)).alias("position", "_bare"))
    )
    return named.select(*rest, "position", F.coalesce(kind, F.lit("fact")).alias("kind"), said.alias("content"))


def pending_queue(pending: DataFrame, limit: int = 20) -> DataFrame:
    return pending.filter(F.col("state") == "pending").orderBy("id").limit(limit)


def decide(pending: DataFrame, ids: DataFrame, state: str) -> DataFrame:
    """Move the named proposals out of the queue; only waiting ones move."""
    named = ids.select("id").distinct().withColumn("_named", F.lit(True))
    moved = F.coalesce(F.col("_named"), F.lit(False)) & (F.col("state") == "pending")
    return (
        pending.join(named, "id", "left")
        .withColumn("state", F.when(moved, F.lit(state)).otherwise(F.col("state")))
        .select(*pending.columns)
    )


def accept(pending: DataFrame, facts: DataFrame, ids: DataFrame, verified: Callable[[DataFrame], DataFrame]):
    """Accepted proposals become facts of priority 50. Returns (pending, facts).

    `verified` adds `verify_state` and `verify_note` to rows with `id` and `content`.
    New ids continue after the largest one; they are dense and follow proposal order.
    """
    named = pending.filter(F.col("state") == "pending").join(ids.select("id").distinct(), "id", "left_semi")
    top = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    from .ordering import dense_index

    rows = dense_index(verified(named), "id", "_n")
    added = rows.select(
        (top + F.col("_n")).alias("id"), "kind", "content", "context", F.lit(50).alias("priority"),
        "verify_state", "verify_note",
    )
    return decide(pending, ids, "accepted"), facts.unionByName(added, allowMissingColumns=True)


# Turns ----------------------------------------------------------------------
def capture(turns: DataFrame, max_chars: int = 4000) -> DataFrame:
    """What the raw layer stores: redacted, then cut."""
    return turns.withColumn("content", F.substring(tx.redact("content"), 1, max_chars))


def within_age(turns: DataFrame, now: Column, days: int = 30, at: str = "created_at") -> DataFrame:
    """Rows no older than the window; 0 keeps everything."""
    if days <= 0:
        return turns
    return turns.filter(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def newest(turns: DataFrame, max_rows: int = 5000, order: str = "id") -> DataFrame:
    """The newest `max_rows` rows by id; 0 keeps everything.

    Only the ids are ranked (a per-partition top-k); the rows are then kept by
    comparing with the oldest surviving id.
    """
    if max_rows <= 0:
        return turns
    oldest = turns.select(order).orderBy(F.col(order).desc()).limit(max_rows).agg(F.min(order)).scalar()
    return turns.filter(F.col(order) >= oldest)


def prune(turns: DataFrame, now: Column, days: int = 30, max_rows: int = 5000) -> DataFrame:
    return newest(within_age(turns, now, days), max_rows)


def forget_turns(turns: DataFrame, session=None) -> DataFrame:
    return turns.filter(F.lit(False)) if session is None else turns.filter(F.col("session_id") != F.lit(session))


def worth_capturing(turns: DataFrame, minimum: int = 6) -> DataFrame:
    return turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns")).filter(F.col("turns") >= minimum)


# Scenarios and persona ------------------------------------------------------
def upsert_latest(writes: DataFrame, key: str = "path", order: str = "id") -> DataFrame:
    """Current row per key from an append-only write log; `version` counts the writes."""
    rest = [c for c in writes.columns if c not in (key, "version")]
    return (
        writes.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"), F.count(F.lit(1)).alias("version"))
        .select(key, "_row.*", "version")
    )


def current_persona(personas: DataFrame) -> DataFrame:
    return personas.agg(F.max_by("content", "id").alias("content"))


# Model-assisted steps -------------------------------------------------------
def missing_vectors(facts: DataFrame, batch: int = 32) -> DataFrame:
    """The next rows a backfill call should embed, oldest first."""
    text = F.concat_ws(" ", "content", F.coalesce("context", F.lit("")))
    return facts.filter(F.col("embedding").isNull()).orderBy("id").limit(batch).select("id", text.alias("text"))


def embed_text_budget(query_prefix: str = "") -> int:
    """Characters of input an embedding request may carry (512 tokens less room, two characters each)."""
    return (512 - 32) * 2 - len(query_prefix)


def embed_missing(facts: DataFrame, embed: Callable[[list[str]], list], batch: int = 32) -> DataFrame:
    """Fill null vectors through `embed`, an injected callable over a batch of texts."""
    import numpy as np
    import pandas as pd

    cap = embed_text_budget()

    def fill_texts(texts):
        out: list = []
        for i in range(0, len(texts), batch):
            out.extend(embed([t[:cap] for t in texts.iloc[i : i + batch]]))
        # Unit length at write time, so that similarity is a plain dot product.
        return pd.Series([np.asarray(v) / (np.linalg.norm(v) or 1.0) for v in out])

    fill = F.pandas_udf(fill_texts, "array<float>")
    text = F.concat_ws(" ", "content", F.coalesce("context", F.lit("")))
    have = facts.filter(F.col("embedding").isNotNull())
    lack = facts.filter(F.col("embedding").isNull()).withColumn("embedding", fill(text))
    return have.unionByName(lack)


