"""PartEnum signatures share what must be shared; components against a comparison of all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mnemoloom.llm import partenum as P
from mnemoloom.llm.components import components


def shingles(text, n):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) * den >= len(x | y) * num:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    group = {}
    for k, (i, _) in enumerate(rows):
        group.setdefault(top(k), []).append(i)
    return sorted((i, len(s), min(group[top(k)])) for k, (i, s) in enumerate(sets))


def test_sets_of_odd_texts():
    r = random.Random(5)
    some = ["", None, "a", "A b", "a b c d", "  é\tx\x0by z q w e", "a b c d e f g a b c d e f g", "\x0b\x0c"]
    some += [" ".join(r.choice("a b c D éé ab".split()) for _ in range(r.randint(0, 30))) for _ in range(100)]
    for n in (4, 5):
        sets, at = P.shingle_sets(pa.array(some), n)
        assert np.diff(at).tolist() == [len(shingles(t, n)) for t in some]
        names = P._names(sets, at)
        same = {}
        for t, name in zip(some, names):
            assert same.setdefault(frozenset(shingles(t, n)), name) == name
        assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("num, den", [(85, 100), (4, 5), (9, 10), (2, 3)])
def test_similar_sets_share_a_signature(num, den):
    rng, bands = np.random.default_rng(num), P.Bands(num, den)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
    for _ in range(300):
        base = draw(int(rng.choice([1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 20, 40, 100, 400])))
        n, lost, new = len(base), 0, 0
        while True:  # up to the threshold
            if rng.random() < 0.5 and (n - lost - 1) * den >= (n + new) * num and n - lost > 1:
                lost += 1
            elif (n - lost) * den >= (n + new + 1) * num:
                new += 1
            else:
                break
        other = np.sort(np.concatenate((base[rng.permutation(n)[lost:]], draw(new))))
        sig, owner = P.signatures(np.concatenate((base, other)), np.array([0, n, n + len(other)]), bands)
        assert set(sig[owner == 0]) & set(sig[owner == 1])
        # What parities and sizes say is no more than the truth.
        bits = P._parities(np.concatenate((base, other)), np.array([0, n, n + len(other)]))
        assert sum(bin((int(a) ^ int(b)) & (1 << 64) - 1).count("1") for a, b in zip(*bits)) <= lost + new


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = text(40), []
    for _ in range(12):
        base = text(r.choice([3, 8, 30, 120]))
        for _ in range(r.randint(1, 7)):  # copies, and chains of edits
            rows.append(" ".join(base))
            if r.random() < 0.7:
                base = list(base)
                base[r.randrange(len(base))] = r.choice(vocabulary)
    rows += [" ".join([*text(r.randint(3, 12)), *passage]) for _ in range(25)]
    rows += ["", None, "   ", "w1", "w1", "W1 w2", "w1 w2"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, n, num, den", [(1, 4, 85, 100), (2, 5, 4, 5)])
def test_components(spark, seed, n, num, den):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cls string").repartition(3)
    got = sorted((x.id, x.n_shingles, x.component_id) for x in P.similar_components(df, n_words=n, num=num, den=den).collect())
    assert got == brute(rows, n, num, den)


def test_similarities_that_signatures_cannot_serve():
    with pytest.raises(ValueError):
        P.Bands(1, 2)


def test_one_of_each_stays(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(3, long, "a"), (5, long + " more", "b"), (3, long, "a"), (7, None, "c"), (7, None, "c"), (8, "", "d"), (9, "other words here", "e"), (None, long, "f"), (None, "alone with no id", "g"), (9, "and again but different", "h")]
    got = P.keep_one(spark.createDataFrame(rows, "doc_id long, text string, mark string")).collect()
    assert sorted((x.doc_id or -1, x.mark) for x in got) == [(-1, "g"), (3, "a"), (7, "c"), (8, "d"), (9, "e"), (9, "h")]
    assert got[0].__fields__ == ["doc_id", "text", "mark"]
    assert P.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(1, k) for k in range(2, 40)]
    got = {x.node: x.component for x in components(spark.createDataFrame(chain + star + [(500, 500)], "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 40)}}


def test_null_and_repeated_ids_lose_nothing(spark):
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(60))
    t = [text() for _ in range(5)]
    # Two near texts under one id, near copies without ids, an id whose texts lie in two components, and clean texts without ids.
    rows = [(9, t[0]), (9, t[0] + " more"), (None, t[1]), (None, t[1] + " more"), (4, t[2]), (4, t[3]), (6, t[2] + " more"), (5, t[3] + " more"), (None, t[4]), (None, text()), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = {(x.id, x.mark): x.component for x in P._placed_rows(df, "doc_id", "text", 5, 4, 5).collect()}
    mark = {x.text: x.m for x in df.selectExpr("text", "xxhash64(text) as m").collect()}
    of = [told[i, mark[x]] for i, x in rows]
    assert of[0] == of[1] and of[2] == of[3] and of[4] == of[6] and of[5] == of[7] and of[10] is of[11] is None and len(set(of)) == 7
    got = [(x.doc_id, x.text) for x in P.keep_one(df).collect()]
    assert len(got) == 8 and {x for x in got if x[1]} >= {(4, t[2]), (4, t[3]), rows[8], rows[9]} and set(got) >= {(None, None), (None, "")}
    assert len({x for x in got if x[0] == 9}) == 1 and len(set(got) & set(rows[2:4])) == 1


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    rows = corpus(4)
    r = random.Random(4)
    base = [f"v{k}" for k in range(80)]
    rows += [(1000 + k, " ".join(f"u{k}" if j == r.randrange(80) else w for j, w in enumerate(base))) for k in range(40)]
    rows += [(2000, " ".join(base)), (2001, " ".join(base)), (None, " ".join(base))]
    sets = [shingles(t, 4) for _, t in rows]
    want = [sum(1 for b in sets[:k] + sets[k + 1 :] if a and b and len(a & b) * 100 >= len(a | b) * 85) for k, a in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (P.BLOCK_SETS, 7):  # in one block, and in several
        monkeypatch.setattr(P, "BLOCK_SETS", size)
        got = [(x.id or -1, x.n_links) for x in P.similar_components(df, n_words=4, num=85, den=100, links=True).collect()]
        assert sorted(got) == sorted((i or -1, n) for (i, _), n in zip(rows, want)) and max(want) > 20


def _tasks(spark, group, run):
    """Result of a function, and how many tasks its jobs had."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)


def test_rounds_of_components_take_few_tasks(spark):
    star = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(100, k) for k in range(101, 140)], "a long, b long").repartition(4)
    rows, tasks = _tasks(spark, "stars", lambda: components(star).collect())
    assert {tuple(r) for r in rows} == {(k, 0) for k in range(40)} | {(k, 100) for k in range(100, 140)}
    assert tasks <= 25
    chain = spark.createDataFrame([(k * 37 % 64, (k + 1) * 37 % 64) for k in range(63)], "a long, b long").repartition(4)
    rows, _ = _tasks(spark, "chain", lambda: components(chain).collect())
    assert {tuple(r) for r in rows} == {(k, 0) for k in range(64)}
