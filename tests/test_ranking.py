"""Fusion without ranks, and vouching for many questions, against plain Python."""

import random

import pytest

from mnemoloom.operators import fulltext, fusion, symbols


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fused_top_equals_fusion_of_ranks(spark, seed):
    r = random.Random(seed)
    a = [(k, float(r.choice([r.random(), 0.5]))) for k in r.sample(range(400), r.choice([0, 3, 200]))]
    b = [(k, float(r.randint(0, 30))) for k in r.sample(range(400), 150)]
    schema = "node_id bigint, score double"
    one, two = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    rank = lambda rows: {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    ra, rb = rank(a), rank(b)
    for limit in (1, 7):
        score = {k: (1 / (60 + ra[k]) if k in ra else 0) + (0.7 / (60 + rb[k]) if k in rb else 0) for k in ra.keys() | rb.keys()}
        want = sorted(score, key=lambda k: (-round(score[k], 12), k))[:limit]
        got = fusion.fused_top(one, two, limit).collect()
        assert [x.node_id for x in got] == want and all(x.cosine == dict(a).get(x.node_id) for x in got)
    alone = fusion.fused_top(None, two, 5).collect()
    assert [x.node_id for x in alone] == sorted(rb, key=rb.get)[:5]


def placed(scored, edges, callable_, seeds=6):
    order = sorted(scored, key=lambda k: (-scored[k], k))
    out = []
    for s in order[:seeds]:
        if s not in out:
            out.append(s)
        near = sorted({b for a, b in edges + [(b, a) for a, b in edges] if a == s and b in callable_ and b not in out}, key=lambda k: (-scored.get(k, 0.0), k))
        out += near[:1]
    return out + [k for k in order if k not in out]


def test_vouching_for_many_questions(spark):
    r = random.Random(5)
    nodes = list(range(30))
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(80)]
    callable_ = {n for n in nodes if n % 4}
    scored = {q: {n: round(r.random(), 1) for n in r.sample(nodes, 20)} for q in range(5)}
    rows = [(q, n, s) for q, m in scored.items() for n, s in m.items()]
    links = spark.createDataFrame(edges, "src int, dst int")
    syms = spark.createDataFrame([(n, n in callable_) for n in nodes], "node_id int, callable boolean")
    got = symbols.vouched(spark.createDataFrame(rows, "qid int, node_id int, score double"), links, syms).collect()
    for q, m in scored.items():
        assert [x.node_id for x in sorted((x for x in got if x.qid == q), key=lambda x: x.rank)] == placed(m, edges, callable_)
    one = symbols.vouched(spark.createDataFrame([(n, s) for n, s in scored[0].items()], "node_id int, score double"), links, syms).collect()
    assert [x.node_id for x in sorted(one, key=lambda x: x.rank)] == placed(scored[0], edges, callable_)


def test_scores_are_the_same_with_many_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k % 5} other{k % 3} word{k % 7} common") for k in range(60)], "id int, text string")
    asked = spark.createDataFrame([(q, f"word{q} other1 common") for q in range(6)], "qid int, text string")
    want = sorted(tuple(x) for x in fulltext.bm25_top(docs, asked, "id", ["text"], 4).collect())
    monkeypatch.setattr(fulltext, "SENT_WEIGHTS", 0)
    assert sorted(tuple(x) for x in fulltext.bm25_top(docs, asked, "id", ["text"], 4).collect()) == want
