"""Retrieval steps whose shuffles and memory stay in proportion to the texts: plans and results."""

from mnemoloom.operators import evaluate, fulltext


def _plan(df):
    return df._jdf.queryExecution().toString()


def _docs(spark):
    words = ["small", "blue", "ring", "gear", "bolt", "test"]
    rows = [(k, " ".join(words[(k + j * j) % 6] for j in range(k % 9)), "c") for k in range(200)] + [(500, None, None), (7, "ring ring", "c")]
    return spark.createDataFrame(rows, "id long, content string, context string").repartition(3)


def test_postings_are_counted_where_texts_of_a_key_are(spark):
    out = fulltext.postings(_docs(spark), "id", ["content", "context"])
    assert "hashpartitioning(id#" in _plan(out) and not any("hashpartitioning" in x and "term#" in x for x in _plan(out).splitlines())
    sevens = {(r.doc_len, r.term, r.tf) for r in out.filter("id = 7").collect()}
    assert (3, "ring", 2) in sevens and len({n for n, _, _ in sevens}) == 2  # rows with one key and other lengths stay apart


def test_scores_take_a_task_per_number_of_pairs(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "small blue ring"), (2, "gear bolt"), (3, "nothing here")], "qid int, text string")
    want = sorted(map(tuple, fulltext.bm25(_docs(spark), asked, "id", ["content", "context"]).collect()))
    monkeypatch.setattr(fulltext, "TASK_PAIRS", 50)
    out = fulltext.bm25(_docs(spark), asked, "id", ["content", "context"])
    assert sorted(map(tuple, out.collect())) == want
    pairs = sum(len(set(q.split()) & set((r.content or "").split())) for _, q in asked.toLocalIterator() for r in _docs(spark).collect())
    assert "hashpartitioning(id#" in _plan(out)
    tasks = [int(x.split("id#")[1].split(", ")[1].split(")")[0]) for x in _plan(out).splitlines() if "REPARTITION_BY_NUM" in x]
    assert min(tasks) >= pairs // 50 > 4


def test_runs_of_texts_are_cut_without_lambdas(spark):
    docs = spark.createDataFrame([(1, "a one two three four five six z"), (2, None), (3, "one two"), (4, "")], "id long, content string")
    asked = spark.createDataFrame([(1, "one two three four five six"), (2, "one two")], "qid int, text string")
    out = evaluate.containing(docs, asked)
    assert {tuple(r) for r in out.collect()} == {(1, 1), (2, 1), (2, 3)}
    generated = [x for x in _plan(out).split("== Physical Plan ==")[1].splitlines() if "Generate explode" in x]
    assert generated and not any("transform(" in x for x in generated) and "UDF(" in _plan(out)
