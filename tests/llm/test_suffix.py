"""Suffix-array matches against a plain search of every window."""

import random
import re

import numpy as np

from mnemoloom.llm import suffix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[k : k + size])):
                    found |= owners
                    hit[k : k + size] = [1] * size
        out.append((len(w), sum(hit), len(found), ",".join(sorted(found))))
    return out


def cases(seed):
    r = random.Random(seed)
    vocabulary = "a b c d é F 7".split()[: r.randint(1, 7)]
    text = lambda n: " ".join(r.choice(vocabulary + ["zz"] * (r.random() < 0.2)) for _ in range(r.randint(0, n)))
    docs = [text(60) for _ in range(8)] + [None, "", "--"]
    items = [(k, text(r.choice([5, 14, 25]))) for k in range(5)] + [(9, None), (10, "")]
    return [*docs, f"{docs[0]} {items[0][1]} {docs[1]}", docs[0]], items


def test_shards_of_any_size():
    for seed in range(120):
        docs, items = cases(seed)
        block, got = suffix.Block([(str(i), t) for i, t in items if t is not None]), []
        size = random.Random(seed).choice([1, 3, 100])
        for at in range(0, len(docs), size):
            texts = [suffix.words_of(t) for t in docs[at : at + size]]
            doc, item, place, word, n = block.find(texts)
            for k, w in enumerate(texts):
                mine, hit = doc == k, np.zeros(len(w), int)
                for a, m, i, p in zip(word[mine], n[mine], item[mine], place[mine]):
                    hit[a : a + m] = 1
                    assert w[a : a + m] == suffix.words_of(dict(items)[int(block.ids[i])])[p : p + m]
                found = sorted({block.ids[i] for i in item[mine]})
                got.append((len(w), int(hit.sum()), len(found), ",".join(found)))
        assert got == brute(docs, items)


def test_suffix_array_is_sorted():
    for seed in range(50):
        codes = np.array([random.Random(seed * 100 + k).choice([0, 1, 1, 2]) for k in range(60)] + [0])
        until = lambda i: list(codes[i : i + list(codes[i:]).index(0)])
        order = suffix.suffix_array(codes)
        assert sorted(order) == list(range(len(codes)))
        assert all(until(a) <= until(b) for a, b in zip(order, order[1:]))


def test_report_in_several_blocks(spark, monkeypatch):
    docs, items = cases(7)
    long = " ".join("q w e r t y u i o p a s".split() * 3)
    docs, items = [*docs, f"x {long} y"], [*items, (11, long), (12, long)]
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(docs)], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    import hashlib

    for size in (1 << 20, 60):
        monkeypatch.setattr(suffix, "BLOCK_BYTES", size)
        got = sorted(tuple(x) for x in suffix.report(frame, bench).collect())
        assert got == [(k, a, b, c, hashlib.sha256(d.encode()).hexdigest(), b > 0) for k, (a, b, c, d) in enumerate(want)]
    assert suffix.report(frame.limit(0), bench).count() == 0
    assert {x.n_hit for x in suffix.report(frame, bench.limit(0)).collect()} == {0}


def test_longest_match_and_its_place(spark):
    item = " ".join(f"w{k}" for k in range(30))
    doc = "start here " + " ".join(f"W{k}" for k in range(5, 22)) + " end"
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    bench = spark.createDataFrame([(8, item)], "item_id long, text string")
    (row,) = suffix.matches(docs, bench).collect()
    assert [tuple(m) for m in row.matches] == [("8", 5, 2, 17)] and row.text == doc
