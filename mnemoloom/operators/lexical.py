"""Word overlap between questions and the fields of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx

FIELDS = ("name", "signature", "doc", "context", "file")


def field_text(columns: list[str], field: str) -> Column:
    """A symbol's text for one scored field; the name field prefers the label."""
    if field == "name":
        return F.coalesce(F.nullif("label", F.lit("")), "name") if "label" in columns else F.col("name")
    return F.col(field) if field in columns else F.lit("")


def weighted_terms(symbols: DataFrame) -> DataFrame:
    """(node_id, term, weight): each word of a symbol with the best field it appears in.

    Settled inside the row, so building the index shuffles nothing.
    """
    by_weight = sorted(fixed.LEXICAL_WEIGHTS.items(), key=lambda kv: -kv[1])
    tokens = symbols.select(
        "node_id", *[tx.query_terms(field_text(symbols.columns, f)).alias(f"_{f}") for f, _ in by_weight]
    )
    arrays = [F.col(f"_{f}") for f, _ in by_weight]

    def weigh(term: Column) -> Column:
        weight = F.lit(None).cast("double")
        for (_, w), array in reversed(list(zip(by_weight, arrays))):
            weight = F.when(F.array_contains(array, term), F.lit(w)).otherwise(weight)
        return F.struct(term.alias("term"), weight.alias("weight"))

    merged = F.transform(F.array_distinct(F.concat(*arrays)), weigh)
    return tokens.select("node_id", F.explode(merged).alias("_t")).select("node_id", "_t.term", "_t.weight")


def question_terms(questions: DataFrame) -> DataFrame:
    terms = questions.select("qid", tx.query_terms("text").alias("_terms"))
    return terms.select("qid", F.size("_terms").alias("asked"), F.explode("_terms").alias("term"))


def scores(symbols: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, node_id, score, matched) of every symbol sharing a word with a question."""
    return (
        weighted_terms(symbols)
        .join(question_terms(questions), "term")
        .groupBy("qid", "node_id")
        .agg(F.sum("weight").alias("_sum"), F.count(F.lit(1)).alias("matched"), F.first("asked").alias("_asked"))
        .select("qid", "node_id", (F.col("_sum") * (1 + F.col("matched") / F.col("_asked"))).alias("score"), "matched")
    )


def with_guesses(
    symbols: DataFrame, questions: DataFrame, guesses: DataFrame | None = None, factor: float = 0.8
) -> DataFrame:
    """Own words, or words guessed for the question, whichever scores better.

    `guesses` is (qid, text): one row per guessed word. A guess is scored apart, so
    it can add a candidate and never demote one.
    """
    own = scores(symbols, questions).select("qid", "node_id", "score")
    if guesses is None:
        return own
    joined = guesses.groupBy("qid").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    other = scores(symbols, joined).select("qid", "node_id", (F.col("score") * factor).alias("score"))
    return own.unionByName(other).groupBy("qid", "node_id").agg(F.max("score").alias("score"))


def with_reach(scored: DataFrame, degrees: DataFrame, cap: int = 6, step: float = 0.05) -> DataFrame:
    """Add a mild correction for symbols other code reaches. `degrees` is (node_id, degree)."""
    reach = F.least(F.coalesce("degree", F.lit(0)), F.lit(cap)) * step
    return scored.join(degrees, "node_id", "left").withColumn("score", F.col("score") + reach).drop("degree")


def overlap(symbols: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many words of a question its answer holds, without and with the module text.

    `pairs` is (qid, text, node_id).
    """
    cols = symbols.columns
    own = F.concat(*[tx.tokens(field_text(cols, f)) for f in ("name", "file", "signature", "doc")])
    whole = F.concat(own, tx.tokens(field_text(cols, "context")))
    terms = tx.query_terms("text")
    return pairs.join(symbols.select("node_id", own.alias("_own"), whole.alias("_whole")), "node_id").select(
        "qid", "node_id",
        F.size(terms).cast("bigint").alias("terms"),
        F.size(F.array_intersect(terms, "_own")).cast("bigint").alias("own_hits"),
        F.size(F.array_intersect(terms, "_whole")).cast("bigint").alias("module_hits"),
    )
