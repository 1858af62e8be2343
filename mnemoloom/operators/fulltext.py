"""Keyword retrieval: BM25 over an inverted view of the texts, for a batch of questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..session import cut, stored
from .ordering import top_per


def _tokens_of(fields: list[str]) -> Column:
    return F.concat(*[tx.index_tokens(f) for f in fields])


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, doc_len, term, tf): the inverted index of `docs`, ready to be stored.

    The texts are dealt by key and their words counted where they arrive: a text is smaller than its words with their keys.
    """
    tokens = docs.select(key, *fields).repartition(key).select(key, _tokens_of(fields).alias("_tokens"))
    return (
        tokens.select(key, F.size("_tokens").alias("doc_len"), F.explode("_tokens").alias("term"))
        .groupBy(key, "doc_len", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, term, qtf); a word asked twice counts twice."""
    return (
        questions.select("qid", F.explode(tx.keyword_terms("text")).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def matched_postings(docs: DataFrame, asked: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, doc_len, term, tf) of the asked terms only, plus one row per document under the empty term.

    The empty term carries the lengths of all documents, so word statistics come out
    of the same single pass over the texts.
    """
    terms = F.concat(F.array(F.lit("")), F.col("_tokens"))
    wanted = asked.select("term").distinct().unionByName(asked.sparkSession.createDataFrame([("",)], "term string"))
    if asked.count() <= SENT_WEIGHTS:
        wanted = F.broadcast(wanted)  # words that nobody asks for are not shuffled
    return (
        docs.select(key, _tokens_of(fields).alias("_tokens"))
        .select(key, F.size("_tokens").alias("doc_len"), F.explode(terms).alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy(key, "doc_len", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


# Weights of asked terms that are sent to every task: some megabytes. More are joined by term.
SENT_WEIGHTS = 100_000
# Pairs of a question's word and a document holding it that one task sums: some hundred bytes each.
TASK_PAIRS = 1 << 20


def bm25(docs: DataFrame, questions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(qid, key, score) for every document sharing a word with a question.

    The texts are read once. The postings that matter are written out, and document
    frequencies, mean length and scores are all taken from them.
    """
    return _scores(docs, cut(question_terms(questions)), key, fields)


def _scores(docs: DataFrame, asked: DataFrame, key: str, fields: list[str]) -> DataFrame:
    found = stored(matched_postings(docs, asked, key, fields))
    totals = found.filter("term = ''").agg(
        F.struct(F.count(F.lit(1)).alias("docs"), F.avg("doc_len").alias("mean_len")).alias("t")
    ).scalar()
    hits = found.filter("term <> ''")
    idf = F.log((F.col("_t.docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weights = (
        hits.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
        .withColumn("_t", totals)
        .join(asked, "term")
        .select("qid", "term", "_t", "_df", (F.col("qtf") * F.greatest(idf, F.lit(fixed.BM25_MIN_IDF))).alias("_weight"))
    )
    # A document's postings stand in one task, and where the weights come to it its scores are summed and ranked there:
    # no (question, document) pair is shuffled.
    if asked.count() <= SENT_WEIGHTS:
        weights = stored(weights)
        pairs = weights.agg(F.sum("_df")).first()[0] or 0
        least = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        weights, hits = F.broadcast(weights), hits.repartition(max(least, -(-pairs // TASK_PAIRS)), key)
    k1, b = fixed.BM25_K1, fixed.BM25_B
    saturated = (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("_t.mean_len")))
    return (
        hits.join(weights, "term")
        .groupBy("qid", key)
        # Rounded so that copies of a text tie whatever order their terms were added in.
        .agg(F.round(F.sum(F.col("_weight") * saturated), 9).alias("score"))
    )


def bm25_top(docs: DataFrame, questions: DataFrame, key: str, fields: list[str], k: int) -> DataFrame:
    return top_per(bm25(docs, questions, key, fields), ["qid"], [F.col("score").desc(), F.col(key)], k)


def keyword_recall(
    questions: DataFrame,
    facts: DataFrame,
    scenarios: DataFrame | None = None,
    turns: DataFrame | None = None,
    limit: int = 8,
    include_superseded: bool = False,
) -> DataFrame:
    """(qid, leg, rank, key): facts, then scenarios, then raw turns, each layer's best `limit * 2`.

    Word statistics cover the whole layer; replaced facts are hidden afterwards.
    """
    best = [F.col("score").desc(), F.col("_key")]
    asked = cut(question_terms(questions))
    scores = _scores(facts, asked, "id", ["content", "context"])
    if not include_superseded:
        scores = scores.join(facts.filter("superseded_by is not null").select("id"), "id", "left_anti")
    legs = [(1, "L1:", scores.withColumnRenamed("id", "_key"))]
    if scenarios is not None:
        found = _scores(scenarios, asked, "path", ["path", "summary", "content"])
        legs.append((2, "L2:", found.withColumnRenamed("path", "_key")))
    if turns is not None:
        legs.append((3, "L0:", _scores(turns, asked, "id", ["content"]).withColumnRenamed("id", "_key")))
    out = None
    for ordinal, prefix, leg in legs:
        ranked = top_per(leg, ["qid"], best, limit * 2).select(
            "qid", F.lit(ordinal).alias("leg"), "rank", F.concat(F.lit(prefix), F.col("_key").cast("string")).alias("key")
        )
        out = ranked if out is None else out.unionByName(ranked)
    return out
