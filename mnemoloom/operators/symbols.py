"""Finding symbols for a question: by meaning, by words, through neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import vectors as vx
from . import fusion, graph, lexical


def semantic_scores(symbols: DataFrame, degrees: DataFrame, asked: Column) -> DataFrame:
    """(node_id, callable, score) of every symbol with an `embedding`, against one query vector."""
    kind = F.when(F.col("callable"), F.lit(1.0)).otherwise(F.lit(0.88))
    reach = F.least(F.coalesce("degree", F.lit(0)), F.lit(6)) * 0.004
    return (
        symbols.filter("embedding is not null")
        .join(degrees.select("node_id", "degree"), "node_id", "left")
        .withColumn("_asked", asked)
        .select("node_id", "callable", (vx.dot("embedding", "_asked") * kind + reach).alias("score"))
    )


def vouched(scored: DataFrame, edges: DataFrame, symbols: DataFrame, seeds: int = 6) -> DataFrame:
    """(node_id, score, rank): semantic order in which each of the best seeds pulls in its best neighbour.

    With a `qid` in `scored` that is done for every question (qid, node_id, score, rank). A seed's choice depends on what
    earlier seeds placed, so a seed can only ever need as many of its neighbours as there are places: the best
    `2 * seeds` per seed. A question's seeds and these are one small array, and the placing is a fold over it.
    """
    from .ordering import dense_index, top_per

    by = [c for c in ("qid",) if c in scored.columns]
    best = [F.col("score").desc(), F.col("node_id")]
    one = scored.select(*by, "node_id", "score") if by else scored.select(F.lit(0).alias("qid"), "node_id", "score")
    top = top_per(one, ["qid"], best, seeds, "_at")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    can_call = symbols.filter("callable").select(F.col("node_id").alias("dst"))
    near = (
        both.join(top.select("qid", F.col("node_id").alias("src")), "src")
        .distinct()
        .join(can_call, "dst", "left_semi")
        .join(one.withColumnRenamed("node_id", "dst"), ["qid", "dst"], "left")
        .select("qid", "src", F.col("dst").alias("node_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    )
    near = top_per(near, ["qid", "src"], best, 2 * seeds)
    options = near.groupBy("qid", F.col("src").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda o: o["node_id"]).alias("options"))
    rows = top.join(options, ["qid", "node_id"], "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_at", "node_id", "options"))).alias("seeds"))
    key = scored.schema["node_id"].dataType.simpleString()
    none = F.array().cast(f"array<{key}>")

    def place(placed: Column, seed: Column) -> Column:
        own = F.when(F.array_contains(placed, seed["node_id"]), placed).otherwise(F.concat(placed, F.array(seed["node_id"])))
        pick = lambda p: F.slice(F.filter(F.coalesce(seed["options"], none), lambda o: ~F.array_contains(p, o)), 1, 1)
        return F.concat(own, pick(own))

    front = rows.select("qid", F.posexplode(F.aggregate("seeds", none, place)).alias("place", "node_id"))
    # A neighbour without a vector has no semantic score of its own; it ranks with zero.
    pool = one.join(front, ["qid", "node_id"], "full").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = [F.col("place").asc_nulls_last(), *best]
    if by:
        numbered = dense_index(pool, [F.col("qid"), *order], "_number")
        first = numbered.groupBy("qid").agg(F.min("_number").alias("_first"))
        return numbered.join(first, "qid").select("qid", "node_id", "score", (F.col("_number") - F.col("_first") + 1).alias("rank"))
    return dense_index(pool, order, "rank").drop("place", "qid")


def search(
    symbols: DataFrame,
    edges: DataFrame,
    question: str,
    vec: list[float] | None = None,
    limit: int = 6,
    guesses: list[str] | None = None,
    expand: bool = True,
) -> DataFrame:
    """(node_id, score, cosine): the symbols one question is about, best first."""
    spark = symbols.sparkSession
    degrees = graph.degree(edges)
    asked = spark.createDataFrame([(0, question)], "qid int, text string")
    extra = spark.createDataFrame([(0, g) for g in guesses], "qid int, text string") if guesses else None
    words = lexical.with_reach(lexical.with_guesses(symbols, asked, extra), degrees).select("node_id", "score")
    semantic = None
    if vec is not None:
        scored = semantic_scores(symbols, degrees, F.array(*[F.lit(float(x)) for x in vec]))
        semantic = vouched(scored, edges, symbols) if expand else fusion.ranked(scored.select("node_id", "score"))
    return fusion.reciprocal_rank(semantic, fusion.ranked(words), limit)


def find_by_name(symbols: DataFrame, edges: DataFrame, question: str, limit: int = 6) -> DataFrame:
    """Words only, over names and paths, callers breaking ties: what a graph without an index can answer."""
    asked = symbols.sparkSession.createDataFrame([(0, question)], "qid int, text string")
    bare = symbols.select("node_id", "name", *(["label"] if "label" in symbols.columns else []), "file")
    callers = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    scored = lexical.with_reach(lexical.scores(bare, asked).select("node_id", "score"), callers, cap=5, step=0.1)
    return scored.orderBy(F.col("score").desc(), "node_id").limit(limit)


def select(
    symbols: DataFrame, edges: DataFrame, question: str, limit: int = 5, vec: list[float] | None = None,
    expander: Callable[[str], str] | None = None, reranker: Callable[[str, list], str] | None = None,
) -> DataFrame:
    """The selection cascade: vectors, else index words, else graph words."""
    if vec is not None:
        guesses = parse_expansion(expander(question)) if expander else None
        wide = search(symbols, edges, question, vec, max(limit * 4, 20), guesses)
        if reranker is not None:
            wide = rerank(wide, reranker, question)
        found = wide.limit(limit)
        if not found.isEmpty():
            return found
    found = search(symbols, edges, question, None, limit)
    if not found.isEmpty():
        return found
    return find_by_name(symbols, edges, question, limit)


def parse_expansion(reply: str, most: int = 12) -> list[str]:
    """The distinct single words of 3 to 39 characters that a reply lists, one per line or comma, marks and quotes aside."""
    listed = (fixed.LIST_MARK.sub("", entry.strip()) for entry in reply.replace("\n", ",").split(","))
    words = dict.fromkeys(entry.translate(fixed.QUOTES) for entry in listed)
    return [w for w in words if 3 <= len(w) <= 39 and " " not in w][:most]


def rerank(ordered: DataFrame, reply_for: Callable[[str, list], str], question: str, keep: int = 4, trust: int = 2):
    """Let a model promote up to `keep` of the tail; the first `trust` places are fixed.

    `ordered` is a short list (a search result). Each row gets a sort key: 0 in a fixed place, 1 if it was
    picked, 2 otherwise; then the order of picking; then its old place. An answer that names nothing valid leaves
    the list as it was.
    """
    placed = ordered.withColumn("_place", F.row_number().over(W.orderBy(F.monotonically_increasing_id())) - 1)
    shown = placed.filter(F.col("_place") >= trust).orderBy("_place").drop("_place").collect()
    if len(shown) < 2:
        return ordered
    reply = reply_for(question, shown)
    numbers = [] if fixed.REPLY_NONE.match(reply) else [int(n) for n in fixed.NUMBER.findall(reply)]
    picks = [n for n in numbers if 1 <= n <= len(shown)][:keep]
    if not picks:
        return ordered
    turn = F.array_position(F.array(*[F.lit(n) for n in picks]), (F.col("_place") - trust + 1).cast("int"))
    rank = F.when(F.col("_place") < trust, 0).when(turn > 0, 1).otherwise(2)
    return placed.orderBy(rank, F.when(rank == 1, turn).otherwise(0), "_place").drop("_place")
