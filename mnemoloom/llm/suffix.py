"""Benchmark decontamination with suffix arrays of the training texts.

Every Arrow batch of documents is a shard. Its words are numbered by the vocabulary of the benchmark
(exactly, through a dictionary; a word outside of it is 0 and ends every match), its suffix array is
built by prefix doubling, and every suffix of the benchmark is searched in it by bisection, one word
deeper at a time. Suffixes that meet a word outside the vocabulary before the shortest window is
full can match nothing and are left out of the array. What is found is joined along its diagonal into
the longest verbatim matches with their places.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import derive

# Bytes of benchmark text that are searched for at a time, and so the size of what is sent to the tasks.
BLOCK_BYTES = 32 << 20
WINDOW = 10

# A-Z in lower case; what is neither a letter, a digit nor outside ASCII separates words.
WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)

MATCHES = "array<struct<item_id: string, item_word: bigint, doc_word: bigint, n_words: bigint>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Block:
    """Some items of the benchmark: their words as numbers, and where their windows begin."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        codes, starts, lengths, owners, places = [0], [], [], [], []
        for k, (_, text) in enumerate(items):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                starts.append(len(codes) + i)
                lengths.append(size)
                owners.append(k)
                places.append(i)
            codes += words
            codes.append(0)
        self.codes = np.asarray(codes + [0] * window, np.int64)
        self.starts, self.lengths, self.owners, self.places = (np.asarray(x, np.int64) for x in (starts, lengths, owners, places))
        self.shortest = min(lengths, default=0)
        self.deepest = max(lengths, default=0)

    def find(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Maximal matches in a shard: document, item, word in the item, word in the document, length."""
        none = (np.zeros(0, np.int64),) * 5
        if not len(self.starts):
            return none
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        codes = np.zeros(int(sizes.sum()), np.int64)
        begin = np.cumsum(sizes) - sizes
        get = self.vocabulary.get
        for at, words in zip(begin.tolist(), texts):
            codes[at : at + len(words)] = list(map(get, words, repeat(0)))
        kept, shard = self._long_runs(codes)
        if not len(kept):
            return none
        array = suffix_array(shard)
        array = array[np.searchsorted(shard[array], 1) :]  # from the first suffix that begins with a word
        window, position = self._search(shard, array)
        if not len(window):
            return none
        position = kept[position]
        doc = np.searchsorted(begin, position, side="right") - 1
        return self._join(doc, window, position - begin[doc])

    def _long_runs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of runs inside the vocabulary that can hold a window, each run closed by a 0, and their places."""
        known = np.concatenate(([False], codes > 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        first, end = edge[::2], edge[1::2]
        long = end - first >= self.shortest
        first, end = first[long], end[long]
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = end - first + 1  # with the 0 that follows
        kept = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return kept, codes[kept]  # every text ends in a 0 of its own

    def _search(self, shard: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window with each place where it stands, by narrowing its interval of the array word by word."""
        padded = np.concatenate((shard, np.zeros(self.deepest + 1, np.int64)))
        live = np.arange(len(self.starts))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(array))
        found, at = [], []
        for depth in range(self.deepest):
            word = self.codes[self.starts[live] + depth]
            low, high = _bound(padded, array, depth, low, high, word, False), _bound(padded, array, depth, low, high, word, True)
            some = low < high
            live, low, high = live[some], low[some], high[some]
            done = self.lengths[live] == depth + 1
            if done.any():
                count = (high - low)[done]
                found.append(np.repeat(live[done], count))
                step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                at.append(array[np.repeat(low[done], count) + step])
                live, low, high = live[~done], low[~done], high[~done]
            if not len(live):
                break
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(at)

    def _join(self, doc: np.ndarray, window: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows that follow each other in the item and in the document become one match."""
        item, place = self.owners[window], self.places[window]
        order = np.lexsort((word, word - place, item, doc))
        doc, item, place, word, size = doc[order], item[order], place[order], word[order], self.lengths[window][order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] != word[:-1] + 1) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        return doc[first], item[first], place[first], word[first], word[last] + size[last] - word[first]


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Positions in the order of what begins there. A 0 ends a text: order beyond it is by position."""
    n, zero = len(codes), codes == 0

    def dense(key: np.ndarray) -> np.ndarray:
        """Ranks from 1 on, and 0 where a text has ended."""
        out = np.zeros(n, np.int64)
        out[~zero] = np.unique(key[~zero], return_inverse=True)[1] + 1
        return out

    rank, step = dense(codes), 1
    longest = int(np.diff(np.concatenate(([-1], np.flatnonzero(zero), [n]))).max())
    while step < longest:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        finer = dense(rank * (int(rank.max()) + 2) + after)
        if finer.max() == rank.max():
            break
        # A suffix that ended within the step had its own rank already, so what follows its 0 decides nothing.
        rank, step = finer, step * 2
    return np.argsort(rank, kind="stable")


def _bound(text, array, depth, low, high, word, above: bool) -> np.ndarray:
    """Bisection for many intervals at once: where the words at this depth reach (or pass) the wanted one."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        seen = text[array[middle] + depth]
        right = seen <= word[open_] if above else seen < word[open_]
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def _scan(docs: DataFrame, items: list[tuple[str, str]], window: int, text: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # about BLOCK_BYTES

    def make():
        b = Block(shared.value, window)

        def run(column):
            texts = [words_of(t) for t in column.to_pylist()]
            doc, item, place, word, size = b.find(texts)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            ids = pa.array(b.ids, pa.string()).take(pa.array(item))
            rows = pa.StructArray.from_arrays([ids, pa.array(place), pa.array(word), pa.array(size)], ["item_id", "item_word", "doc_word", "n_words"])
            return [pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)]

        return run

    return derive(docs, [keep.index(text) if text in keep else F.col(text)], [F.col(c) for c in keep], f"n_words bigint, matches {MATCHES}", make)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """The kept columns (all, if none are named), `n_words`, and `matches`: the longest verbatim matches of a window or more.

    Items are searched for in blocks of a bounded size, one scan of the documents per block. Null and
    empty texts have no words and no matches, nor have items without words; repeated items report
    under their own ids, repeated documents stay repeated. Input columns named `n_words` or
    `matches` are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "matches")] if keep is None else keep
    items = benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    out = None
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()  # one block
        block = sorted((r.i, r.t) for r in rows)
        if out is None:
            out = _scan(docs, block, window, text, keep if blocks == 1 else [*keep, *([text] if text not in keep else [])])
        else:
            before = stored(out.withColumnRenamed("matches", "_before"))
            out = _scan(before, block, window, text, [c for c in before.columns if c not in ("n_words",)])
            out = out.withColumn("matches", F.concat("_before", "matches")).drop("_before")
    return out if blocks == 1 else out.select(*keep, "n_words", "matches")


def hit_words(matches: str = "matches"):
    """Words inside any match: the length of the union of their ranges."""
    ordered = f"array_sort(transform({matches}, m -> struct(m.doc_word as a, m.doc_word + m.n_words as b)))"
    step = "(s, m) -> named_struct('n', s.n + greatest(m.b - greatest(m.a, s.e), 0L), 'e', greatest(s.e, m.b))"
    return F.expr(f"aggregate({ordered}, named_struct('n', 0L, 'e', 0L), {step}, s -> s.n)")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: its words, those inside a benchmark window, and the items found in it."""
    found = matches(docs, benchmark, keep=["doc_id"])
    items = F.expr("array_sort(array_distinct(transform(matches, m -> m.item_id)))")
    n = hit_words()
    return found.select(
        "doc_id", "n_words", n.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )
