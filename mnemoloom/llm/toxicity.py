"""Toxicity by a chain of linear classifiers.

The categories are predicted in a fixed order, each from the text's features and from the
probabilities of the categories before it. The models are fitted on a bounded sample of labelled
documents; what a later model sees of an earlier one in training are out-of-fold predictions, so it
learns how far these can be trusted on texts that the earlier one has not seen.

Features are whether one of the chosen byte n-grams or words occurs anywhere in the text. N-grams
carry words built upon a known stem; presence does not thin out in long texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import derive, utf8, word_spans

# Labelled documents of the sample, half of them with the last category where there are enough.
SAMPLE = 4000
# Hash buckets of n-grams and words, and how many of them are features.
BITS = 20
FEATURES = 3000
FOLDS = 5

# A-Z in lower case, digits alike, white space and control characters a blank.
_SEEN = np.array([32 if c <= 32 or c == 127 else c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint32)
_LETTER = np.array([c > 127 or 97 <= c <= 122 for c in range(256)])


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint32(salt)) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def occurrences(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every 4-byte and 6-byte window that begins in or right before a word, and of every word."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    seen = _SEEN[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = offsets[1:][row] - np.arange(len(data))
    padded = np.concatenate((seen, np.full(6, 32, np.uint32)))
    at = [padded[k : k + len(data)] for k in range(6)]
    four = at[0] << np.uint32(24) | at[1] << np.uint32(16) | at[2] << np.uint32(8) | at[3]
    six = _hash(four, 11) ^ (at[4] << np.uint32(8) | at[5]) * np.uint32(0x9E3779B1)
    solid = (at[1] != 32) & (at[2] != 32)
    ok4 = solid & (left >= 4)
    ok6 = solid & (at[3] != 32) & (at[4] != 32) & (left >= 6)
    start, end, of = word_spans(seen.astype(np.uint8), offsets, _LETTER)
    # A word is the sum of its bytes, each spread by its place in the word.
    place = np.arange(len(data), dtype=np.int64)
    begin = np.zeros(len(data), np.int64)
    begin[start] = start
    begin = np.maximum.accumulate(begin)
    mixed = _hash(seen * np.uint32(0x01000193) + (place - begin).astype(np.uint32), 5).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    word = _hash((sums[end] - sums[start]).astype(np.uint32), 17)
    shift = np.uint32(32 - BITS)
    return (
        np.concatenate((_hash(four[ok4], 3) >> shift, _hash(six[ok6], 7) >> shift, word >> shift)),
        np.concatenate((row[ok4], row[ok6], of)),
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, rounds: int = 150) -> np.ndarray:
    """Weights (the last one the bias) of a logistic regression whose two sides weigh the same; accelerated gradient steps."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(15):
        v = x.T @ (weight * (x @ v))
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = 1 / (0.25 * float(v @ (x.T @ (weight * (x @ v)))) + penalty)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * ahead
        new = ahead - step * gradient
        ahead = new + (t / (t + 3)) * (new - w)
        w = new
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """Chosen buckets and one model per category."""

    def __init__(self, names: list[str], buckets: np.ndarray, worth: np.ndarray, models: list[np.ndarray]):
        self.names, self.buckets, self.worth, self.models = names, buckets, worth, models

    @staticmethod
    def fit(names: list[str], texts: list[np.ndarray], labels: np.ndarray) -> Chain:
        """`texts`: distinct buckets of each text; `labels`: texts by categories."""
        buckets = _choose(texts, labels)
        x = _matrix(texts, buckets)
        # Rare features weigh more, so that those which decide outweigh the many that a long text has anyway.
        worth = np.log(1 / (x.mean(axis=0) + 1e-3)).astype(np.float32)
        x *= worth
        # Copies of a text are in one fold: which one follows from its buckets.
        fold = np.array([int(t.astype(np.uint64).sum()) % FOLDS for t in texts])
        models = []
        for k in range(len(names)):
            y = labels[:, k].astype(bool)
            models.append(fit_logistic(x, y))
            out = np.zeros(len(x), np.float32)
            for f in range(FOLDS):
                held = fold == f
                if held.any() and not held.all():
                    out[held] = _probability(x[held], fit_logistic(x[~held], y[~held]))
            x = np.concatenate((x, out[:, None]), axis=1)
        return Chain(names, buckets, worth, models)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by texts and categories, from which features are present."""
        x, found = x * self.worth, []
        for w in self.models:
            p = _probability(x, w)
            found.append(p)
            x = np.concatenate((x, p[:, None].astype(np.float32)), axis=1)
        return np.stack(found, axis=1)


def _choose(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets that part the categories best: by the log-likelihood ratio of their presence, equally many for each."""
    size = 1 << BITS
    everywhere = np.bincount(np.concatenate(texts), minlength=size)
    chosen: list[np.ndarray] = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(bool)
        inside = np.bincount(np.concatenate([t for t, p in zip(texts, y) if p] or [np.zeros(0, np.int64)]), minlength=size)
        n, m = max(1, y.sum()), max(1, (~y).sum())
        a, b = inside, everywhere - inside
        rate = (a + b) / (n + m)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.nan_to_num(a * np.log(a / n / rate)) + np.nan_to_num(b * np.log(b / m / rate))
        order = np.argsort(-gain, kind="stable")[: FEATURES // labels.shape[1]]
        chosen.append(order[gain[order] > 0])
    return np.unique(np.concatenate(chosen))


def _matrix(texts: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    index = np.full(1 << BITS, -1, np.int32)
    index[buckets] = np.arange(len(buckets))
    out = np.zeros((len(texts), len(buckets)), np.float32)
    for k, t in enumerate(texts):
        column = index[t]
        out[k, column[column >= 0]] = 1
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain | None:
    """A chain over `categories`, names and conditions on the label rows in the order of the chain.

    A label row with an undetermined category is not used, nor one without a document. The sample is
    drawn by a hash of the key, half from the rows in the last category and half from the others.
    """
    names = list(categories)
    rows = labels.select(F.col(key).alias("id"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]).dropna()
    last = f"y{len(names) - 1}"
    sizes = {r[0]: r[1] for r in rows.groupBy(last).count().collect()}  # two rows at most
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30))
    chosen = F.lit(False)
    for value, n in sizes.items():
        chosen = chosen | ((F.col(last) == value) & (draw < int(min(1.0, sample / 2 / n) * (1 << 30))))
    drawn = F.broadcast(rows.filter(chosen))  # of `sample` rows
    both = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(drawn, "id")

    def make():
        def run(column):
            bucket, row = occurrences(column)
            distinct = np.unique(row << BITS | bucket.astype(np.int64))
            ends = np.searchsorted(distinct, np.arange(len(column) + 1) << BITS)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((distinct & (1 << BITS) - 1).astype(np.int32)))
            return [lists]

        return run

    got = derive(both, [F.col("text")], [F.col("id"), *[F.col(f"y{i}") for i in range(len(names))]], "x array<int>", make).toArrow()
    if got.num_rows == 0:
        return None
    got = got.sort_by("id")
    texts = [np.asarray(x.values, np.int64) for x in got["x"]]
    y = np.stack([np.asarray(got[f"y{i}"]) for i in range(len(names))], axis=1)
    return Chain.fit(names, texts, y)


def predict(docs: DataFrame, chain: Chain | None, names: list[str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if none are named) and a probability per category, in the order of the chain.

    Whole texts; a null, empty or wordless text has no features, and without a chain all
    probabilities are 0. Equal texts get equal answers. Input columns with the categories' names are replaced.
    """
    keep = [c for c in docs.columns if c not in names] if keep is None else keep

    def make():
        index = np.full(1 << BITS, -1, np.int32)
        if chain:
            index[chain.buckets] = np.arange(len(chain.buckets))

        def run(column):
            n = len(column)
            if chain is None:
                return [pa.array(np.zeros(n)) for _ in names]
            bucket, row = occurrences(column)
            feature = index[bucket]
            x = np.zeros((n, len(chain.buckets)), np.float32)
            x[row[feature >= 0], feature[feature >= 0]] = 1
            p = chain.predict(x)
            p[~x.any(axis=1)] = 0
            return [pa.array(p[:, k].astype(np.float64)) for k in range(len(names))]

        return run

    return derive(docs, [F.col(text)], [F.col(c) for c in keep], ", ".join(f"`{n}` double" for n in names), make)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document the probabilities of low quality, toxicity and both together, and whether it is toxic."""
    categories = {
        "p_low_quality": F.col("quality") == 0, "p_severe": (F.col("toxic") == 1) & (F.col("quality") == 0), "p_toxic": F.col("toxic") == 1,
    }
    out = predict(docs, fit(docs, labels, categories), list(categories), keep=["doc_id"])
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)
