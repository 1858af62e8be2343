"""A training corpus from raw documents: language, near-copies, benchmark leaks, secrets, token ids.

Each stage takes what the one before it kept, read back from Parquet in the shared folder, works on all of
it, and returns the columns of `documents`; the last one returns the encoded corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoloom.llm import bpe, langid, partenum, secretscan, suffix
from mnemoloom.llm.common import prepare
from mnemoloom.session import stored

RANKS = "byte_bpe_multi_50k.tiktoken"


def _renamed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The columns under names that meet none of an operator, and that of the text among them."""
    return docs.toDF(*[f"column_{k}" for k in range(len(docs.columns))]), f"column_{docs.columns.index('text')}"


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"column_{k}").alias(c) for k, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; gibberish and those without letters, null texts among them, go."""
    prepare(spark)
    model = langid.fit(docs)
    if model is None:
        # Nothing is labelled, so there is no language to be in; what has letters stays.
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows, text = _renamed(docs)
    return _restored(langid.predict(rows, model, text, keep=rows.columns, known=True).filter("known"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more."""
    prepare(spark)
    return partenum.keep_one(docs, n_words=5, num=4, den=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, text = _renamed(docs)
    return _restored(suffix.matches(rows, benchmark, text, keep=rows.columns).filter(F.size("matches") == 0), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark, and `n_chars` of the new text."""
    prepare(spark)
    rows, text = _renamed(docs)
    out = _restored(secretscan.redact(rows, text), docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids (little-endian unsigned 32-bit), checked by decoding: `round_trip` says that the text came back."""
    prepare(spark)
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    keep = ["doc_id", "lang", "source", "text"]
    encoded = bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, RANKS, keep=keep)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), same.alias("round_trip"), "ids")


STAGES = [
    ("language_id", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("byte_bpe", encode),
]

# Classifiers and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read back."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
