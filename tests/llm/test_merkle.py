"""The Merkle manifest against trees built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mnemoloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, pos int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level):
    """Root of a list of digests, and for each of them the digests left and right on every level."""
    ways, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for w, a in zip(ways, at):
            run = runs[a // 16]
            w.append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
        at = [a // 16 for a in at]
        level = [H(*r) for r in runs]
    return level[0], ways


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    root, over = climb([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, over):
        for r, way in zip(groups[s], trees[s][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            fold = leaf((*r[:4], text)) if hit else leaf(r)
            for left, right in way + up:
                fold = H(left, fold, right)
            out.append((r[0], leaf(r), trees[s][0], root, H(*(x for p in way + up for x in p)), fold, fold == root))
    return out


def rows(seed):
    r = random.Random(seed)
    out = [(k * 3 - 50, "hot", "en", k, f"Text {k} É") for k in range(300)]  # several words, negative ids
    out += [(r.choice([r.randrange(-(2**63), 2**63), r.randrange(100)]), f"s{r.randrange(20)}", None, None, None) for _ in range(100)]
    out += [(2**63 - 1, "hot", None, 1, ""), (-(2**63), "hot", "x", 1, "A"), (63, "one", "x", 0, "Lone"), (0, "", "x", 0, "é"), (5, None, "de", 7, "N"), (127, "é", "-", 1, "a:b")]
    out += [(None, "hot", "x", k % 9, "NULL") for k in range(40)] + [(7, "hot", "x", k % 5, "Tie") for k in range(40)] + [(64, "two", "x", 1, "same")] * 35
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_trees_in_memory(spark, seed):
    data = rows(seed)
    docs = spark.createDataFrame([(*x, "p", 1) for x in data], SCHEMA)
    got = [tuple(x) for x in merkle.report(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(data), key=str)
    assert not all(x[-1] for x in got) and any(x[-1] for x in got)


def test_small_tables(spark):
    for data in ([], [(1, "a", "b", 2, "c")], [(1, None, None, None, None)] * 17, [(k, f"s{k}", "b", 2, "C") for k in range(3)]):
        got = [tuple(x) for x in merkle.report(spark.createDataFrame([(*x, "p", 1) for x in data], SCHEMA)).collect()]
        assert sorted(got, key=str) == sorted(brute(data) if data else [], key=str)


def test_places_follow_the_keys(spark):
    ids = random.Random(3).sample(range(-(10**6), 10**6), 2000)
    frame = spark.createDataFrame([("g", i, f"{i:x}") for i in ids], "grp string, id long, leaf string")
    got = sorted((x.pos, x.id) for x in merkle.placed(frame).collect())
    assert got == list(enumerate(sorted(ids)))


def test_rows_of_a_table_with_other_fields(spark):
    docs = spark.createDataFrame([(k, k % 2, f"v{k}") for k in range(40)], "seq int, part int, value string")
    out = merkle.manifest(docs, fields=["value"], group="part", order="seq")
    assert out.filter(merkle.folded(F.col("leaf")) == F.col("root")).count() == 40 and out.select("root").distinct().count() == 1
