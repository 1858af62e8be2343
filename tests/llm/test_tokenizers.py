"""Byte-level BPE and spliced token counts against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers

from mnemoloom.llm import bpe, tokens

PARTS = ["a", "b", "th", "er", " ", "  ", "\n", "'s", "'", "1", "é", "ß", "日本", "!", "<|endoftext|>", "\x85", "\x1c", "=", "zzzz", "œ", "\U00010ee7a", " 😀"]


def texts(seed, n=400, longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def multi():
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ranks, library


def test_encoding_is_the_librarys(multi):
    ranks, library = multi
    some = [*texts(1), "", "x" * 20_000, "日" * 3000]
    got = bpe.encoder(ranks, P.PATTERN, "test", bpe.unsettled_class())(some)
    assert got == [np.asarray(library.encode_ordinary(t), "<u4").tobytes() for t in some]


def test_new_letters_are_classed_as_the_library_does(multi):
    ranks, library = multi
    find = bpe.Splitter(P.PATTERN, bpe.unsettled_class()).unsettled
    some = [f"a{c}a {c}{c}1{c} !{c}" for c in map(chr, range(0x10D00, 0x11400)) if find.match(c)]
    assert some
    got = bpe.encoder(ranks, P.PATTERN, "test", bpe.unsettled_class())(some)
    assert got == [np.asarray(library.encode_ordinary(t), "<u4").tobytes() for t in some]


def test_prefixes_after_appends_and_edits(multi):
    ranks, _ = multi
    v, r = bpe.Vocabulary(ranks), random.Random(3)
    plain = lambda data: [ranks[p] for p in v.merged(data)]
    for _ in range(60):
        state, data = bpe.Prefixes(v), b""
        for _ in range(6):
            new = r.choice(["er", "the", "ß", " a", "zz"]).encode() * r.randint(1, 3)
            if data and r.random() < 0.5:
                i = r.randint(0, len(data))
                j = r.randint(i, len(data))
                state.edit(i, j, new)
                data = data[:i] + new + data[j:]
            else:
                state.append(new)
                data += new
            assert state.ids() == plain(data) and state.data == data
            k = r.randint(0, len(data))
            assert bpe.Prefixes(v, data[:k]).last == state.last[: k + 1]


def test_fits_is_what_merging_says(multi):
    ranks, _ = multi
    v, r = bpe.Vocabulary(ranks), random.Random(4)
    for _ in range(3000):
        a, b = r.choice(v.bytes_of), r.choice(v.bytes_of)
        assert v.fits(ranks[a], ranks[b]) == (v.merged(a + b) == [a, b])


def test_digests_of_odd_rows(spark, multi):
    ranks, library = multi
    rows = [(1, "héllo  wörld", "x"), (1, "héllo  wörld", "x"), (2, None, None), (3, "", "y"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.digests(df, ranks, P.PATTERN, "test").collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(x) for x in got] == sorted(want, key=lambda x: str(next(g for g in got if tuple(g) == x)))
    assert bpe.digests(df.limit(0), ranks, P.PATTERN, "test").count() == 0
    assert bpe.encode_texts(df, ranks, P.PATTERN, "test").columns == ["doc_id", "text", "ids", "decoded"]


@pytest.fixture(scope="module")
def definition():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_counts_are_the_librarys(definition):
    library, encoder = tokenizers.Tokenizer.from_str(definition), tokens.Encoder(definition)
    some = texts(2)
    want = [len(library.encode(t, add_special_tokens=False)) for t in some]
    assert encoder.counts(some) == want
    for chunk, overlap in ((8, 4), (20, 2), (200, 8)):
        assert [tokens.count_huge(t, encoder, chunk, overlap) for t in some] == want


def test_counts_by_another_kind_of_tokenizer():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        other = f.read()
    library, encoder = tokenizers.Tokenizer.from_str(other), tokens.Encoder(other)
    some = texts(5, 50)
    assert not encoder.chunks
    assert encoder.counts(some) == [len(library.encode(t, add_special_tokens=False)) for t in some]


def test_report_of_odd_rows(spark, definition):
    rows = [(1, "a b" * 70_000, 1), (2, None, 2), (3, "", 3), (3, "", 3), (4, "é<|endoftext|>", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(tuple(x) for x in tokens.report(df, definition, "test").collect())
    library = tokenizers.Tokenizer.from_str(definition)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False))
    assert got == sorted((i, len((t or "").encode()), size(t), size(t) > 512) for i, t, _ in rows)
    assert tokens.report(df.limit(0), definition, "test").count() == 0
