"""Suffix order by linear grouping, and removal of repeated passages, against plain counts of all windows."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from mnemoloom.llm import lyndon


def test_order_of_suffixes():
    for seed in range(1500):
        r = random.Random(seed)
        codes = [r.randint(1, r.randint(1, 4)) for _ in range(r.randint(0, 40))] + [0]
        assert lyndon.suffix_order(codes) == sorted(range(len(codes)), key=lambda i: codes[i:])
    for codes in ([0], [1] * 300 + [0], [1, 2] * 100 + [0], list(range(200, -1, -1)), [*range(1, 200), 0]):
        assert lyndon.suffix_order(codes) == sorted(range(len(codes)), key=lambda i: codes[i:])


def test_windows_of_a_shard():
    for seed in range(200):
        r = random.Random(seed)
        texts = [bytes(r.choice(b"\0ab") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6))]
        window = r.randint(1, 8)
        seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
        want = [[seen[t[i : i + window]] > 1 for i in range(len(t) - window + 1)] for t in texts]
        assert [x.tolist() for x in lyndon.repeated_windows(texts, window)] == want


def test_windows_told_by_blocks(monkeypatch):
    """With places, few symbols are sorted, and equal windows are those that are equal around their places."""
    sorted_ = []
    order = lyndon.suffix_order
    monkeypatch.setattr(lyndon, "suffix_order", lambda codes: sorted_.append(len(codes)) or order(codes))
    for seed in range(200):
        r = random.Random(seed)
        window, mark = r.randint(16, 60), bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 6)))
        sides = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 90))) for _ in range(3)]
        texts, places = [], []
        for _ in range(r.randint(2, 8)):
            left, right = r.choice(sides)[r.randint(0, 20) :][-(window - len(mark)) :], r.choice(sides)[: r.randint(0, window - len(mark))]
            texts.append(left + mark + right)
            places.append(len(left))
        starts = [[(t[i : i + window], i - p) for i in range(len(t) - window + 1)] for t, p in zip(texts, places)]
        seen = collections.Counter(w for ws in starts for w in ws)
        assert [x.tolist() for x in lyndon.repeated_windows(texts, window, places)] == [[seen[w] > 1 for w in ws] for ws in starts]
    r = random.Random(1)
    base = bytes(r.choice(b"abcdefgh ") for _ in range(760))
    texts = [base[:k] + b"x" + base[k + 1 :] for k in range(0, 760, 19)]
    told = lyndon.repeated_windows(texts, 400, [360] * len(texts))
    assert sorted_[-1] * 7 < sum(map(len, texts))
    assert [x.tolist() for x in told] == [x.tolist() for x in lyndon.repeated_windows(texts, 400)]


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    common, passage = text(900), text(450)
    texts = [None, "", text(399), text(50), common, common, common[:500], "é" * 1500, "ab" * 700, "\0" * 450, text(300) + common[100:800] + text(300)]
    texts += [text(r.randint(0, 200)) + passage + text(r.randint(0, 200)) for _ in range(30)]
    for _ in range(10):  # near copies
        k = r.randint(0, 899)
        texts.append(common[:k] + r.choice("xyz") + common[k + 1 :])
    once = text(401)
    return [*texts, once + text(20) + once, text(3000), passage * 3]


def test_repeats_of_400_bytes(spark):
    texts = corpus(1)
    # Keys repeat or are null; a column has the name of an internal one.
    rows = [(None if k % 7 == 0 else k // 2, t, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = [tuple(x) for x in lyndon.report(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, *b) for (i, _, _), b in zip(rows, brute(texts, 400))), key=str)


def test_large_shards_are_dealt_by_offset(spark):
    texts = corpus(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window, shard in ((400, 2000), (40, 60), (7, 30)):
        out = lyndon.remove_repeats(docs, window=window, shard_bytes=shard).collect()
        got = {x.doc_id: (sum(r.end - r.first for r in x.removed), len(x.removed), hashlib.sha256(x.kept).hexdigest()) for x in out}
        assert got == {k: b[1:] for k, b in enumerate(brute(texts, window))}, window


def keyed(spark, texts, parts):
    rows = [(hashlib.sha256(t.encode()).digest()[:16], t) for t in texts]
    return spark.createDataFrame(rows, "id binary, text string").withColumn("t", F.xxhash64("text")).repartition(parts)


def test_copies_of_a_text_are_cut_once(spark):
    """Rows of pieces follow the different texts of a slice and not their copies, whose number they carry."""
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(800))
    docs = keyed(spark, ["x" * 450, *[text] * 200, "y" * 450], 1)
    known = lyndon._samples(docs, 400).groupBy("t").agg(F.collect_set("h").alias("known"))
    rows = [x for x in lyndon._pieces(docs.join(known, "t", "left"), 400).collect() if bytes(x.id) == hashlib.sha256(text.encode()).digest()[:16]]
    assert rows and len(rows) == len({x.start for x in rows})
    assert {x.docs for x in rows} == {200}
    out = lyndon.report(spark.createDataFrame([(k, t) for k, t in enumerate([text] * 200 + [text[:500], "z" * 600])], "doc_id long, text string"))
    assert {(x.n_bytes, x.n_removed, x.n_spans) for x in out.collect()} == {(800, 800, 1), (500, 500, 1), (600, 600, 1)}


def test_a_crowd_of_copies_is_split(spark):
    """The join that fetches the texts of pieces deals the copies of one text to several tasks."""
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(600)) for _ in range(60)]
    docs = keyed(spark, texts + texts[:1] * 4000, 8)
    wanted = docs.select("id", F.lit(0).cast("bigint").alias("start"), F.lit(450).cast("bigint").alias("size"), F.col("id").alias("piece")).distinct()
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = lyndon._texts(docs, wanted)
        assert sorted(bytes(x.text) for x in out.collect()) == sorted(t[:450].encode() for t in texts)
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_empty_table(spark):
    assert lyndon.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
