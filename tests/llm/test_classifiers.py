"""Held-out accuracy of the classifiers, and odd rows."""

import pytest

from mnemoloom.llm import langid, toxicity
from mnemoloom.llm.common import prepare

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    prepare(spark)
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache(), spark.read.parquet(f"{SMALL}/labels.parquet").cache()


def test_languages_of_held_out_documents(spark, tables):
    docs, _ = tables
    lang = {x.doc_id: x.lang for x in docs.collect()}
    got = langid.report(docs).collect()
    held = [x for x in got if x.held_out]
    assert len(got) == len(lang) and 0.2 < len(held) / len(got) < 0.3
    assert sum(x.lang_pred == lang[x.doc_id] for x in held) / len(held) > 0.98
    assert all(0 <= x.score <= 1 for x in got)


def test_language_is_read_from_the_text_alone(spark, tables):
    docs, _ = tables
    model = langid.fit(docs)
    text = docs.filter("lang = 'fr' and n_chars > 500").first().text
    rows = [(1, text, "en", "x"), (2, text, None, "y"), (2, text, None, "y"), (3, None, "en", "z"), (4, "", "en", "z"), (5, "123 !?", "fr", "z"), (6, text * 50, "de", "z"), (7, "日本語", "en", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.predict(df, model).collect()
    assert [x.lang_pred for x in got[:7]] == ["fr", "fr", "fr", "und", "und", "und", "fr"] and got[7].lang_pred != "und"
    assert got[0].score == got[1].score and abs(got[0].score - got[6].score) < 0.01 and got[3].score == 0
    assert langid.predict(df.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0))
    assert none is None and {x.lang_pred for x in langid.predict(df, none).collect()} == {"und"}


def test_one_language_and_families(spark):
    df = spark.createDataFrame([(k, f"uno dos tres {k}", "es") for k in range(10)], "doc_id long, text string, lang string")
    assert {(x.lang_pred, x.score) for x in langid.predict(df, langid.fit(df)).collect()} == {("es", 1.0)}
    model = langid.fit(df.union(spark.createDataFrame([(k + 50, f"one two three {k}", "en") for k in range(10)] + [(k + 80, f"xyz zyx {k}", "q-own") for k in range(10)], "doc_id long, text string, lang string")))
    assert model.families.classes == ["germanic", "q-own", "romance"]


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (prepare(spark).read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    toxic = {x.doc_id: x.toxic for x in labels.collect()}
    got = [x for x in toxicity.report(docs, labels.filter("doc_id % 5 <> 0")).collect() if x.doc_id % 5 == 0 and x.doc_id in toxic]
    caught = [x.toxic for x in got if toxic[x.doc_id]]
    wrong = [x.toxic for x in got if not toxic[x.doc_id]]
    assert sum(caught) / len(caught) > 0.93 and sum(wrong) / len(wrong) < 0.02


def test_toxicity_of_odd_rows(spark, tables):
    docs, labels = tables
    chain = toxicity.fit(docs, labels, {"low": labels.quality == 0, "toxic": labels.toxic == 1})
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "\n --- ", "c"), (4, "word " * 50_000, "d"), (4, "word " * 50_000, "d")], "doc_id long, text string, toxic string")
    got = toxicity.predict(df, chain, ["low", "toxic"]).collect()
    assert [x.toxic for x in got[:2]] == [0, 0] and got[3] == got[4] and got[0].__fields__ == ["doc_id", "text", "low", "toxic"]
    assert toxicity.predict(df.limit(0), chain, ["low", "toxic"]).count() == 0
    assert toxicity.fit(docs, labels.limit(0), {"toxic": labels.toxic == 1}) is None
    assert {x.toxic for x in toxicity.predict(df, None, ["low", "toxic"]).collect()} == {0.0}


def test_later_models_see_earlier_ones():
    import numpy as np

    rng = np.random.default_rng(1)
    texts = [np.unique(np.concatenate((rng.integers(0, 1000, 20), [5000] if k % 2 else [6000]))) for k in range(200)]
    y = np.array([[k % 2, k % 2] for k in range(200)])
    chain = toxicity.Chain.fit(["a", "b"], texts, y)
    assert len(chain.models[1]) == len(chain.models[0]) + 1 and chain.models[1][-2] > 0.1


def test_the_language_stage_rejects_what_is_no_labelled_language(spark, tables):
    import random

    import corpus_pipeline as C

    docs, r = tables[0], random.Random(1)
    odd = {
        -1: "".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(400)),
        -2: "x " + "".join(r.choice("$%&/()=?#+*0123456789 ") for _ in range(400)),
        -3: "Ala ma kota a kot ma mleko, w Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie. " * 3,
        -4: "Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил. " * 3,
    }
    rows = [(k, t, None, "odd", len(t)) for k, t in odd.items()]
    kept = {x.doc_id for x in C.language(spark, docs.union(spark.createDataFrame(rows, docs.schema)), SMALL).collect()}
    # All labelled documents with letters stay; before, so did the odd ones.
    assert not kept & odd.keys() and kept == {x.doc_id for x in docs.filter(r"text rlike '\\p{L}'").collect()}


def scalar_frequencies(text):
    """Trigram buckets by a dictionary, one byte at a time."""
    seen = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text.encode()]
    count = {}
    for k in range(len(seen)):
        a, b, c = (seen[k + i] if k + i < len(seen) else 32 for i in range(3))
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        h = ((h ^ h >> 15) * 0x27D4EB2F & 0xFFFFFFFF) >> 21
        count[h] = count.get(h, 0) + 1
    return {h: n / len(seen) for h, n in count.items()}


def scalar_decision(votes, freq):
    """Votes and summed chances pair by pair."""
    import math

    won, chance = [0] * len(votes.classes), [0.0] * len(votes.classes)
    if not votes.pairs:
        return 0, 1.0
    for k, (a, b) in enumerate(votes.pairs):
        margin = sum(votes.weights[k][h] * f for h, f in freq.items()) + votes.bias[k]
        p = 1 / (1 + math.exp(-max(-40, min(40, votes.slope[k] * margin))))
        won[a if p >= 0.5 else b] += 1
        chance[a] += p
        chance[b] += 1 - p
    best = max(range(len(won)), key=lambda c: (won[c], chance[c]))
    return best, chance[best] / (len(won) - 1)


def test_languages_by_scalar_loops(spark, tables):
    docs, _ = tables
    model = langid.fit(docs)
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(docs, model, keep=["doc_id"]).collect()}
    for row in docs.filter("doc_id % 5 = 0").collect():
        if not row.text or not any(c.isalpha() for c in row.text):
            assert got[row.doc_id] == ("und", 0.0)
            continue
        freq = scalar_frequencies(row.text)
        family, chance = scalar_decision(model.families, freq)
        best, inner = scalar_decision(model.within[family], freq)
        assert got[row.doc_id][0] == model.within[family].classes[best]
        assert abs(got[row.doc_id][1] - chance * inner) < 1e-4


def test_sixty_languages_and_one_key_have_a_level_each(spark):
    """A word of its own per language; all rows under one key, some of them many times."""
    import itertools

    words = ["".join(w) for w in itertools.product("bdfgk", "aeiou", "lmnrs")][:60]
    codes = [code for family in langid.FAMILIES.values() for code in family.split()][:60]
    codes += [f"x{k}" for k in range(60 - len(codes))]
    rows = [(7, f"{w} {w}{k % 10} {w}{'o' * (k // 10)} {k}", c) for w, c in zip(words, codes) for k in range(30)]
    df = spark.createDataFrame(rows + rows[:30] * 20, "doc_id long, text string, lang string")
    model = langid.fit(df, sample=100)
    assert model.middle.keys() == set(codes) and model.level < float("inf")
    empty = df.select(df.doc_id.cast("string").alias("doc_id"), "text", "lang").filter("doc_id is null")
    assert langid.fit(empty) is None
    assert langid.fit(df.selectExpr("cast(null as long) doc_id", "text", "lang"), sample=100).middle.keys() == set(codes)
