"""The pipeline on a small corpus, stage by stage, and the registered queries."""

import re

import pytest
from harness import difference

import corpus_pipeline as C
from mnemoloom.llm import queries as Q
from mnemoloom.plans.registry import Query

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = C.prepare(spark).read.parquet(f"{SMALL}/documents.parquet"), {}
    out["start"] = docs
    for name, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, SMALL))
        out[name] = docs
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "near_copies", "benchmark_leaks", "secrets", "byte_bpe"]
    for name in ("language_id", "near_copies", "benchmark_leaks", "secrets"):
        assert stages[name].dtypes == stages["start"].dtypes


def test_near_copies_are_those_of_all_pairs(stages):
    from test_partenum import brute

    rows = [(x.doc_id, x.text) for x in stages["language_id"].collect()]
    assert sorted(x.doc_id for x in stages["near_copies"].collect()) == sorted(i for i, _, c in brute(rows, 5, 4, 5) if i == c)


def test_leaks_are_those_of_all_windows(spark, stages):
    from test_suffix import brute

    items = [tuple(x) for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = stages["near_copies"].collect()
    clean = [x.doc_id for x, (_, hit, *_) in zip(rows, brute([x.text for x in rows], items)) if not hit]
    assert 0 < len(clean) < len(rows) and sorted(clean) == sorted(x.doc_id for x in stages["benchmark_leaks"].collect())


def test_secrets_are_gone_and_nothing_else(stages):
    before = {x.doc_id: x for x in stages["benchmark_leaks"].collect()}
    after = {x.doc_id: x for x in stages["secrets"].collect()}
    assert before.keys() == after.keys()
    for i, x in after.items():
        assert not re.search(r"[0-9a-f]{16,}", x.text) and x.n_chars == len(x.text)
        if not re.search(r"[0-9a-f]{16,}|AKIA|[A-Za-z0-9+/_=-]{20,}", before[i].text):
            assert x == before[i]


def test_ids_decode_to_the_texts(stages):
    rows = stages["byte_bpe"].collect()
    assert all(x.round_trip and len(x.ids) == 4 * x.n_tokens for x in rows) and len(rows) == stages["secrets"].count()


def test_odd_documents(spark):
    long = " ".join(f"wort{k}" for k in range(200))
    rows = [(1, long, "de", "s", 5, "x"), (2, long, "de", "s", 5, "x"), (1, long, "de", "s", 5, "x"), (3, None, None, None, None, "x"), (4, "", "en", "s", 0, "x"), (5, "no label but letters", None, "s", 1, "x"), (6, "word " * 100_000, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    kept = docs
    for _, stage in C.STAGES[:4]:
        kept = C.stored(stage(spark, kept, SMALL))
    assert sorted(x.doc_id for x in kept.collect()) == [1, 5, 6] and kept.columns == docs.columns
    assert C.STAGES[4][1](spark, kept, SMALL).filter("round_trip").count() == 3
    for _, stage in C.STAGES:
        assert C.stored(stage(spark, docs.limit(0), SMALL)).count() == 0


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_queries_match_their_sql(spark, oracle, name):
    assert difference(spark, oracle, Query(name, Q.QUERIES[name], Q.SQL[name]), SMALL) is None


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_queries_run(spark, name):
    df = Q.QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
