"""Measuring retrieval: hit rates, reciprocal rank, packet sizes."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = r"[\p{L}\p{N}]+"
ANCHOR = 4


def containing(docs: DataFrame, items: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(qid, key): documents whose text contains a question's text verbatim.

    Whole tokens inside the question (all but its first and last) must be tokens of
    the document too, so a run of them is an exact join key; `contains` settles the
    candidates. The anchor is a question's rarest-looking run: its longest.
    """
    tokens = F.regexp_extract_all(F.col("text"), F.lit(_TOKEN), F.lit(0))
    asked = items.select("qid", "text", tokens.alias("_t"))
    long_enough = F.size("_t") >= ANCHOR + 2

    def runs(array, first, last):
        return F.transform(
            F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(
                F.length(F.array_join(F.slice(array, i, ANCHOR), " ")).alias("size"),
                F.array_join(F.slice(array, i, ANCHOR), " ").alias("run"),
            ),
        )

    inner = runs(F.col("_t"), F.lit(2), F.size("_t") - F.lit(ANCHOR))
    anchors = asked.filter(long_enough).select("qid", "text", F.array_max(inner)["run"].alias("_run"))
    short = asked.filter(~long_enough)
    body = docs.select(key, F.col(text).alias("_body"))
    doc_tokens = body.select(key, F.coalesce(F.regexp_extract_all("_body", F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>")).alias("_t"))
    doc_runs = NGram(n=ANCHOR, inputCol="_t", outputCol="_runs").transform(doc_tokens)
    seen = (
        doc_runs.select(key, F.explode("_runs").alias("_run"))
        .join(anchors, "_run")
        .select(key, "qid", "text")
        .distinct()
    )
    found = seen.join(body, key).filter(F.contains(F.col("_body"), F.col("text"))).select("qid", key)
    if short.isEmpty():
        return found
    # Questions too short to anchor ride along with every text as one small array.
    listed = short.agg(F.collect_list(F.struct("qid", "text"))).scalar()
    held = F.filter("_listed", lambda q: F.contains(F.col("_body"), q["text"]))
    rest = body.withColumn("_listed", listed).select(key, F.explode(held).alias("_q")).select(F.col("_q.qid").alias("qid"), key)
    return found.unionByName(rest)


def metrics(hits: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """hit@1, hit@3, hit@5 and mean reciprocal rank over every question that has an answer.

    `hits` is (qid, key, rank); a question takes the best rank of its answers.
    """
    best = truth.join(hits, ["qid", key], "left").groupBy("qid").agg(F.min("rank").alias("_rank"))
    return best.agg(
        F.count(F.lit(1)).alias("questions"),
        *[F.count_if(F.col("_rank") <= k).alias(f"hit_{k}") for k in (1, 3, 5)],
        F.avg(F.coalesce(F.lit(1.0) / F.col("_rank"), F.lit(0.0))).alias("mrr"),
    )


def packet_size(packet: DataFrame, files: DataFrame) -> DataFrame:
    """Characters of a packet (qid, file, chars) beside the distinct files (file, size) it stands for."""
    replaced = packet.select("qid", "file").distinct().join(files, "file").groupBy("qid").agg(F.sum("size").alias("baseline"))
    return (
        packet.groupBy("qid").agg(F.sum("chars").alias("packet"))
        .join(replaced, "qid", "left")
        .withColumn("smaller_pct", F.when(F.col("baseline") > 0, F.lit(100.0) - F.col("packet") / F.col("baseline") * 100))
    )
