"""Putting ranked lists together: rank fusion, ordered union, budgeted selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions import vectors as vx
from .ordering import dense_index, top_per


def ranked(scored: DataFrame, key: str = "node_id") -> DataFrame:
    """Add a 1-based `rank` over the whole list, best first, ties by key."""
    return dense_index(scored, [F.col("score").desc(), F.col(key)], "rank")


def reciprocal_rank(
    semantic: DataFrame | None, lexical: DataFrame, limit: int, key: str = "node_id", k: int = fixed.RRF_K
) -> DataFrame:
    """Merge two ranked lists (key, score, rank) by position. `cosine` carries the semantic score.

    Words weigh 0.7 beside meaning and 1 alone.
    """
    parts = []
    if semantic is not None:
        parts.append(semantic.select(key, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("_part"), F.col("score").alias("cosine")))
    weight = 0.7 if semantic is not None else 1.0
    parts.append(lexical.select(key, (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("_part"), F.lit(None).cast("double").alias("cosine")))
    merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (
        merged.groupBy(key)
        .agg(F.sum("_part").alias("score"), F.max("cosine").alias("cosine"))
        .orderBy(F.col("score").desc(), key)
        .limit(limit)
    )


def _counted_ranks(scored: DataFrame, key: str, asked: list) -> dict:
    """Ranks of a few rows (score, key) of a list: each row of the list says how many of them stand before it, and these are counted."""
    if not asked:
        return {}
    best_first = sorted(asked, key=lambda r: (-r[0], r[1]))
    kind = scored.schema[key].dataType.simpleString()
    given = scored.sparkSession.createDataFrame([(best_first,)], f"_asked array<struct<score:double,key:{kind}>>")
    before = F.size(F.filter("_asked", lambda c: (c.score > F.col("score")) | ((c.score == F.col("score")) & (c.key < F.col(key)))))
    # One row with at most as many entries as there are candidates.
    placed = scored.join(F.broadcast(given.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).groupBy(before.alias("at")).count()
    counts = {r["at"]: r["count"] for r in placed.collect()}
    out, rank = {}, 0
    for at, (_, name) in enumerate(best_first):
        rank += counts.get(at, 0)
        out[name] = rank
    return out


def fused_top(semantic: DataFrame | None, lexical: DataFrame, limit: int, key: str = "node_id", k: int = fixed.RRF_K) -> DataFrame:
    """`reciprocal_rank` of two scored lists (key, score) that nobody has ranked, without sorting either.

    The first rows of both are the candidates; the rank of one in the other list is counted. What was not among the first `m` of
    either is below the sum of two parts at m + 1, so once the last of the answer is above that, the answer stands; else
    `m` doubles. Scores must not be NaN.
    """
    lists = [(semantic, 1.0), (lexical, 0.7)] if semantic is not None else [(lexical, 1.0)]
    lists = [(d.select(key, F.col("score").cast("double").alias("score")), w) for d, w in lists]
    best, m = [F.col("score").desc(), F.col(key)], 2 * limit
    while True:
        firsts = [[(r["score"], r[key]) for r in d.orderBy(*best).limit(m).collect()] for d, _ in lists]  # m rows each
        names = {name for rows in firsts for _, name in rows}
        parts: dict = {n: [] for n in names}
        cosine: dict = {}
        for at, ((d, weight), rows) in enumerate(zip(lists, firsts)):
            ranks = {name: i + 1 for i, (_, name) in enumerate(rows)}
            missing = sorted(names - ranks.keys())
            found = [(r["score"], r[key]) for r in d.join(_keys(d, key, missing), key).collect()] if missing and len(rows) == m else []
            ranks |= _counted_ranks(d, key, found)
            for name, rank in ranks.items():
                parts[name].append(weight / (k + rank))
            if at == 0 and semantic is not None:
                cosine = {name: score for score, name in [*rows, *found]}
        answer = sorted(((sum(p), n) for n, p in parts.items()), key=lambda r: (-r[0], r[1]))[:limit]
        unseen = sum(w / (k + m + 1) for _, w in lists)
        if all(len(rows) < m for rows in firsts) or (len(answer) == limit and answer[-1][0] > unseen):
            break
        m *= 2
    kind = lexical.schema[key].dataType.simpleString()
    return lexical.sparkSession.createDataFrame([(n, s, cosine.get(n)) for s, n in answer], f"{key} {kind}, score double, cosine double")


def _keys(df: DataFrame, key: str, names: list) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return F.broadcast(df.sparkSession.createDataFrame([(n,) for n in names], f"{key} {kind}"))  # at most the candidates


def federated(hits: DataFrame, limit: int, refuse: bool = False) -> DataFrame:
    """Merge hits of several services: scored ones best first, then the rest in their own order.

    `hits` is (service, position, id, score); NaN counts as unscored. With `refuse`
    the services' own orders are fused instead of comparing scores across them.
    """
    if refuse:
        return hits.orderBy("position", "service").limit(limit)
    scored = F.col("score").isNotNull() & ~F.isnan("score")
    return hits.orderBy(
        F.when(scored, 0).otherwise(1), F.when(scored, F.col("score")).desc_nulls_last(), "service", "position"
    ).limit(limit)


def ordered_union(legs: DataFrame) -> DataFrame:
    """(qid, leg, rank, key): one row per key, in leg order; the first mention wins."""
    return legs.groupBy("qid", "key").agg(F.min(F.struct("leg", "rank")).alias("_at")).select(
        "qid", "key", "_at.leg", "_at.rank"
    )


def budgeted(candidates: DataFrame, limit: int = 8, budget: int = 6000, redundant: float = 0.93) -> DataFrame:
    """Greedy selection within a character budget, per question.

    `candidates` is (qid, leg, rank, key, chars, vec); each question brings the few
    dozen rows its legs returned, so the fold runs over a small array. A candidate
    resembling one already chosen is a duplicate; one that does not fit is passed
    over and smaller later ones may still fit; the first one is always taken.
    Returns (qid, selected: array of keys in order, used, duplicates, overflow).
    """
    limit, budget = tx.clamp(limit, 1, 50), tx.clamp(budget, 500, 40000)
    rows = candidates.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("leg", "rank", "key", "chars", F.col("vec").cast("array<double>").alias("vec")))).alias("_rows")
    )
    start = F.struct(
        F.array().cast("array<string>").alias("selected"),
        F.array().cast("array<array<double>>").alias("vecs"),
        F.lit(0).cast("bigint").alias("used"),
        F.lit(0).cast("bigint").alias("duplicates"),
        F.lit(0).cast("bigint").alias("overflow"),
    )

    def step(acc, row):
        full = F.size(acc["selected"]) >= limit
        same = row["vec"].isNotNull() & F.exists(acc["vecs"], lambda v: vx.dot(v, row["vec"]) >= redundant)
        wide = (acc["used"] + row["chars"] > budget) & (F.size(acc["selected"]) > 0)
        duplicate = ~full & same
        over = full | (~same & wide)
        take = ~duplicate & ~over
        chosen_vec = F.when(row["vec"].isNotNull(), F.array(row["vec"])).otherwise(F.array().cast("array<array<double>>"))
        return F.struct(
            F.when(take, F.concat(acc["selected"], F.array(row["key"]))).otherwise(acc["selected"]).alias("selected"),
            F.when(take, F.concat(acc["vecs"], chosen_vec)).otherwise(acc["vecs"]).alias("vecs"),
            (acc["used"] + F.when(take, row["chars"]).otherwise(F.lit(0)).cast("bigint")).alias("used"),
            (acc["duplicates"] + duplicate.cast("bigint")).alias("duplicates"),
            (acc["overflow"] + over.cast("bigint")).alias("overflow"),
        )

    return rows.select("qid", F.aggregate("_rows", start, step).alias("_r")).select(
        "qid", "_r.selected", "_r.used", "_r.duplicates", "_r.overflow"
    )


def top_scores(scored: DataFrame, keys: list[str], key: str, k: int) -> DataFrame:
    return top_per(scored, keys, [F.col("score").desc(), F.col(key)], k)
