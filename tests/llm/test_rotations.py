"""Links of embeddings against all cosines."""

import collections

import numpy as np
import pytest

from mnemoloom.llm import rotations as R


def brute(rows, threshold):
    groups, parent, links = collections.defaultdict(list), {i: i for i, *_ in rows}, collections.Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups[label, len(v)].append((i, np.asarray(v, float) / np.linalg.norm(v)))
    for members in groups.values():
        for k, (i, x) in enumerate(members):
            for j, y in members[:k]:
                if x @ y >= threshold:
                    links.update((i, j))
                    a, b = top(i), top(j)
                    parent[max(a, b)] = min(a, b)
    return sorted((i, links[i], top(i), top(i) == i) for i, *_ in rows)


@pytest.mark.parametrize("cell, block", [(4096, 1024), (32, 16)])
def test_links(spark, monkeypatch, cell, block):
    monkeypatch.setattr(R, "CELL", cell)
    monkeypatch.setattr(R, "BLOCK", block)
    rng = np.random.default_rng(0)
    base, rows = rng.standard_normal((20, 24)), []
    for i in range(400):
        v = base[i % 20] + rng.standard_normal(24) * rng.choice([0, 0.05, 0.1, 0.2])
        rows.append((i, [float(x) for x in v], [1, 1, None, 2][i % 13 % 4]))
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [nan] * 24, 1), (1004, [1.0, None], 1), (1005, [inf] * 24, 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [1e-200, 2e-200], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cls string").repartition(3)
    got = sorted((x.id, x.n_links, x.component_id, x.kept) for x in R.near_duplicates(df).collect())
    rows[-1] = (1008, [1.0, 2.0], 1)
    assert got == brute(rows, 0.98)


def test_empty_and_unlinked(spark):
    assert R.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    (row,) = R.near_duplicates(spark.createDataFrame([(4, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert tuple(row) == (4, 0, 4, True)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 64))
    v[300:] = v[:300] + 0.3 * rng.standard_normal((300, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    rotated, code, factor = R.encode(unit)
    exact = unit @ unit.T
    estimate = rotated @ code.T / (8 * factor)
    assert abs((estimate - exact).mean()) < 2e-3
    assert (R.upper_bounds(rotated, code, factor) >= exact).mean() > 0.99999


def test_tables_find_pairs_at_the_threshold():
    rng, found, n = np.random.default_rng(3), 0, 3000
    a = rng.standard_normal((n, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, 48))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for bits in (0, 1, 4, 9):
        hit = np.zeros(n, bool)
        for t in range(R.tables_for(bits, 0.98)):
            hit |= R.cell_keys(a, t, bits) == R.cell_keys(b, t, bits)
        assert hit.mean() > 0.999


def test_ids_may_be_null_or_repeat(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 1), (1, b, 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (None, a, 2), (None, [1.0, 0.01], 2), (None, b, 1), (None, None, 1)]
    got = [tuple(x) for x in R.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()]
    want = [(1, 1, 1, True), (2, 1, 1, False), (1, 2, 1, True), (3, 2, 1, False), (None, 2, 1, False)] + [(None, 1, None, True)] * 2 + [(None, 0, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
