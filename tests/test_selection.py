"""Selection, first-wins removal, budgets, vouching: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoloom.operators import fusion, memory, recall, symbols
from mnemoloom.operators.firstwins import keep_first_wins, nearest_known
from mnemoloom.operators.ordering import dense_index, next_in_group, suffix_within

VEC = "id bigint, embedding array<float>"


def unit(rng, near=None, spread=0.3):
    v = rng.normal(size=8) if near is None else near + spread * rng.normal(size=8)
    return v / np.linalg.norm(v)


def crowd(seed, n=120):
    """Vectors a third of which are exact or near copies of one."""
    rng = np.random.default_rng(seed)
    centre = unit(rng)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append(centre if i % 6 == 0 else unit(rng, centre, 0.02))
        else:
            out.append(unit(rng))
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)]


def greedy(rows, known, threshold):
    kept, base = [], [np.array(v, dtype=np.float32).astype(float) for _, v in known]
    for i, v in rows:
        a = np.array(v, dtype=np.float32).astype(float)
        if all(a @ b < threshold for b in base):
            kept.append(i)
            base.append(a)
    return kept


@pytest.mark.parametrize("batch", [7, 4096])
def test_first_wins_matches_a_sequential_scan(spark, batch):
    rows, known = crowd(1), crowd(2)[:20]
    got = keep_first_wins(spark.createDataFrame(rows, VEC), spark.createDataFrame(known, VEC), 0.6, batch=batch)
    assert sorted(r.id for r in got.collect()) == greedy(rows, known, 0.6)


def test_first_wins_keeps_what_cannot_be_compared(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0, 0.0])]
    got = keep_first_wins(spark.createDataFrame(rows, VEC), None, 0.9)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("threshold", [0.6, 0.97])
def test_first_wins_ships_few_copies(spark, monkeypatch, threshold):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in unit(rng)]) for i in range(300)]
    known = [(i, [float(x) for x in unit(rng)]) for i in range(100)]
    shipped, frame = [], type(spark.range(0))
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *by: shipped.append(self.count()) or dealt(self, *by))
    got = keep_first_wins(spark.createDataFrame(rows, VEC), spark.createDataFrame(known, VEC), threshold, batch=100)
    assert sorted(r.id for r in got.collect()) == greedy(rows, known, threshold)
    assert max(shipped) <= 5 * len(rows)


def test_first_wins_ships_copies_of_a_known_vector_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in unit(rng)]) for i in range(200)]
    known = [(i, rows[7][1]) for i in range(2000)]
    shipped, frame = [], type(spark.range(0))
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *by: shipped.append(self.count()) or dealt(self, *by))
    got = keep_first_wins(spark.createDataFrame(rows, VEC), spark.createDataFrame(known, VEC), 0.6, batch=100)
    assert sorted(r.id for r in got.collect()) == greedy(rows, known[:1], 0.6)
    assert max(shipped) <= 5 * len(rows)


def test_first_wins_takes_an_id_as_a_whole(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (2, [0.8, 0.6, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    rows.append((None, [0.6, 0.0, 0.8]))
    for batch in (1, 4096):
        got = keep_first_wins(spark.createDataFrame(rows, VEC), None, 0.7, batch=batch)
        assert sorted(r.id for r in got.collect()) == [1, 4, 4]


def test_first_wins_over_empty_vectors(spark):
    got = keep_first_wins(spark.createDataFrame([(1, []), (2, []), (3, None)], VEC), None, 0.0)
    assert sorted(r.id for r in got.collect()) == [1, 3]


@pytest.mark.parametrize("step", [0.05, 0.3])
def test_first_wins_over_long_chains(spark, step):
    rows = [(i, [float(np.cos(step * i / 4)), float(np.sin(step * i / 4))]) for i in range(60)]
    got = keep_first_wins(spark.createDataFrame(rows, VEC), None, 0.995, batch=10)
    assert sorted(r.id for r in got.collect()) == greedy(rows, [], 0.995)


def test_nearest_known_ranks_ties_by_id(spark):
    known = [(i, [1.0, 0.0]) for i in (5, 3, 9, 1)] + [(7, [0.0, 1.0])]
    got = nearest_known(spark.createDataFrame([(3, [1.0, 0.0])], VEC), spark.createDataFrame(known, VEC), 0.5, 2)
    assert [(r.new_id, r.id) for r in got.orderBy("rank").collect()] == [(3, 1), (3, 5)]


def test_novel_by_text_and_meaning(spark):
    schema = "id bigint, content string, embedding array<float>"
    mine = spark.createDataFrame([(1, "The Cache lives in /var", [1.0, 0.0])], schema)
    new = spark.createDataFrame(
        [(10, "the cache -- lives in VAR!", [0.0, 1.0]), (11, "reworded", [0.99, 0.14]), (12, "other", [0.0, 1.0]), (13, "OTHER", [0.6, 0.8])],
        schema,
    )
    assert [r.id for r in memory.novel(new, mine).orderBy("id").collect()] == [12]


def pick(rows, limit, budget, redundant):
    chosen, used, dup, over = [], 0, 0, 0
    for key, chars, vec in rows:
        if len(chosen) >= limit:
            over += 1
        elif vec is not None and any(v is not None and np.dot(v, vec) >= redundant for _, v in chosen):
            dup += 1
        elif used + chars > budget and chosen:
            over += 1
        else:
            chosen.append((key, vec))
            used += chars
    return [k for k, _ in chosen], used, dup, over


@pytest.mark.parametrize("seed", range(4))
def test_budget_fold(spark, seed):
    rng, nrng = random.Random(seed), np.random.default_rng(seed)
    rows = []
    for i in range(40):
        vec = [float(x) for x in unit(nrng)] if rng.random() < 0.5 else None
        rows.append((f"k{i}", rng.randint(50, 900), vec))
    df = spark.createDataFrame([(0, 0, i, k, c, v) for i, (k, c, v) in enumerate(rows)], "qid int, leg int, rank int, key string, chars int, vec array<double>")
    got = fusion.budgeted(df, 6, 2000, 0.5).first()
    assert (got.selected, got.used, got.duplicates, got.overflow) == pick(rows, 6, 2000, 0.5)


def test_first_candidate_is_always_taken_and_small_ones_fit_later(spark):
    rows = [(0, 0, 0, "big", 900, None), (0, 0, 1, "wide", 400, None), (0, 0, 2, "tiny", 10, None)]
    df = spark.createDataFrame(rows, "qid int, leg int, rank int, key string, chars int, vec array<double>")
    got = fusion.budgeted(df, 8, 500).first()
    assert (got.selected, got.used, got.overflow) == (["big"], 900, 2)


def test_recall_prefers_meaning_and_hides_the_superseded(spark):
    schema = "id bigint, kind string, context string, content string, verify_state string, verify_note string, superseded_by bigint, embedding array<float>"
    facts = spark.createDataFrame(
        [
            (1, "fact", "db", "the store is sqlite", None, None, None, [0.0, 1.0]),
            (2, "fact", "", "sessions expire nightly", "stale", "missing: /x", None, [1.0, 0.0]),
            (3, "fact", "", "sessions never expire", None, None, 2, [1.0, 0.0]),
        ],
        schema,
    )
    q = spark.createDataFrame([(0, "which sqlite store", [1.0, 0.0])], "qid int, text string, embedding array<float>")
    assert recall.recall(q, facts).first().selected == ["L1:2", "L1:1"]
    lines = {r.key: r.line for r in recall.lines(facts).collect()}
    assert lines["L1:2"] == "[L1:2] (fact !stale: missing: /x) sessions expire nightly"
    assert lines["L1:1"] == "[L1:1] (fact @db) the store is sqlite"


def test_vouching_pulls_one_neighbour_behind_each_seed(spark):
    scored = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.1), ("d", 0.2)], "node_id string, score double")
    syms = spark.createDataFrame([(n, n != "e") for n in "abcde"], "node_id string, callable boolean")
    edges = spark.createDataFrame([("a", "c"), ("d", "b"), ("e", "a")], "src string, dst string")
    got = symbols.vouched(scored, edges, syms, seeds=2).orderBy("rank").collect()
    assert [r.node_id for r in got] == ["a", "c", "b", "d"]


def test_expansion_and_rerank(spark):
    assert symbols.parse_expansion("- addEvent, 2. task_log\n`x`, two words, addEvent") == ["addEvent", "task_log"]
    rows = spark.createDataFrame([(c, i) for i, c in enumerate("abcdef")], "node_id string, n int")
    got = symbols.rerank(rows, lambda q, tail: "3, 1, 99", "q").collect()
    assert [r.node_id for r in got] == ["a", "b", "e", "c", "d", "f"]
    assert symbols.rerank(rows, lambda q, tail: "NONE", "q") is rows


def test_federated_puts_unscored_last(spark):
    hits = spark.createDataFrame(
        [("s", 1, "x", 0.2), ("s", 2, "y", float("nan")), ("t", 1, "z", 0.9), ("t", 2, "w", None)],
        "service string, position int, id string, score double",
    )
    assert [r.id for r in fusion.federated(hits, 4).collect()] == ["z", "x", "y", "w"]


def test_orderings_over_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.randint(1, 50)) for i in range(3000)] + [("cold", i, 10) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, pos int, n int")
    for key in ("hot", "cold"):
        total, want = 0, []
        for _, pos, n in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1]):
            total += n
            if total > 2000:
                break
            want.append(pos)
        got = suffix_within(df, "k", "pos", "n", 2000, block=64).filter(F.col("k") == key)
        assert sorted(r.pos for r in got.collect()) == sorted(want)
    sparse = sorted(rng.sample(range(100000), 400))
    lines = spark.createDataFrame([("f", x) for x in sparse], "k string, x int")
    got = {r.x: r.nxt for r in next_in_group(lines, "k", "x", "nxt", block=128).collect()}
    assert got == dict(zip(sparse, sparse[1:] + [None]))
    ranked = dense_index(lines, [F.col("x").desc()], "r").collect()
    assert {r.x: r.r for r in ranked} == {x: i + 1 for i, x in enumerate(reversed(sparse))}


def test_nearest_known_has_no_cap(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    known = [(i, [float(x) for x in rng.standard_normal(4 if i % 9 else 3)]) for i in range(60)]
    new = [(1000 + i, [float(x) for x in rng.standard_normal(4)]) for i in range(100)]
    got = nearest_known(spark.createDataFrame(new, VEC), spark.createDataFrame(known, VEC).repartition(3), -9.0, 3, batch=40).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {i: [k for _, k in sorted((-dot(v, w), k) for k, w in known)[:3]] for i, v in new}
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.new_id, []).append(r.id)
    assert found == want
