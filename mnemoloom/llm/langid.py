"""Language identification in two steps: the family first, then the languages within it.

Both steps vote among one-versus-one linear support vector machines over hashed byte trigrams of the
whole text. The machines are fitted on a bounded sample of labelled documents; prediction reads only
the text. A linear score of relative frequencies is a mean of weights over the positions of a text, so
a document of any length is scored in one pass over its bytes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import top_per
from .common import derive, utf8

# Labelled documents that a model is fitted on, all languages together.
SAMPLE = 1000
# Buckets of the hashed trigrams.
BUCKETS = 2048
UNDETERMINED = "und"

# Families of languages by their codes; a fixed table. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky tt",
    "indo-aryan": "hi ur bn pa gu mr ne",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# Bytes as the trigrams see them: A-Z in lower case, all other ASCII but letters a blank.
_SEEN = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint32)


def trigrams(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at every byte of a batch, and each text's first position. None spans two texts."""
    data, offsets = utf8(column)
    seen = _SEEN[data]
    padded = np.concatenate((seen, np.full(2, 32, np.uint32)))
    second, third = padded[1:-1].copy(), padded[2:].copy()
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    second[ends - 1] = 32
    third[ends - 1] = 32
    last_but_one = ends[(ends >= 2)] - 2
    third[last_but_one] = 32
    mixed = (seen * np.uint32(0x9E3779B1)) ^ (second * np.uint32(0x85EBCA77)) ^ (third * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1), offsets


def frequencies(column) -> np.ndarray:
    """Relative frequencies, one row of buckets per text."""
    index, offsets = trigrams(column)
    out = np.zeros((len(column), BUCKETS), np.float32)
    for k in range(len(column)):
        a, b = offsets[k], offsets[k + 1]
        if b > a:
            out[k] = np.bincount(index[a:b], minlength=BUCKETS) / (b - a)
    return out


def fit_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float, float]:
    """A linear support vector machine: squared hinge loss by accelerated gradient steps. Weights, bias, and the slope of its margin.

    Both sides weigh the same, however many rows each has.
    """
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
    # The curvature of the loss bounds the step.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = 1 / (2 * float(v @ (x.T @ (weight * (x @ v)))) + penalty)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        short = np.maximum(0, 1 - y * (x @ ahead))
        gradient = penalty * ahead - 2 * (x.T @ (weight * y * short))
        new = ahead - step * gradient
        ahead = new + (t / (t + 3)) * (new - w)
        w = new
    margin = y * (x @ w)
    middle = float(np.median(margin)) or 1.0
    return w[:-1].astype(np.float64), float(w[-1]), 4.0 / max(middle, 1e-6)


class Votes:
    """One-versus-one machines between the classes of one decision."""

    def __init__(self, classes: list[str], x: np.ndarray, labels: np.ndarray):
        self.classes = classes
        self.pairs = list(combinations(range(len(classes)), 2))
        fitted = []
        for a, b in self.pairs:
            rows = (labels == classes[a]) | (labels == classes[b])
            fitted.append(fit_svm(x[rows], labels[rows] == classes[a]))
        self.weights = np.array([w for w, _, _ in fitted]).reshape(len(fitted), x.shape[1])
        self.bias = np.array([b for _, b, _ in fitted])
        self.slope = np.array([s for _, _, s in fitted])

    def decide(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class with most votes (of equals the one with the larger sum of probabilities) and its mean probability."""
        votes = np.zeros((len(means), len(self.classes)))
        chance = np.zeros_like(votes)
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(self.slope[k] * (means[:, k] + self.bias[k]), -40, 40)))
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            chance[:, a] += p
            chance[:, b] += 1 - p
        if not self.pairs:
            return np.zeros(len(means), np.int64), np.ones(len(means))
        best = np.argmax(votes * len(self.classes) + chance, axis=1)
        return best, chance[np.arange(len(means)), best] / (len(self.classes) - 1)


# Held-out documents of a language from which its middle is taken; with fewer there is none.
LEAST_HELD_OUT = 20
# A document of so many bytes varies as much by its shortness as by its content.
SHORT_BYTES = 200


def expected(x: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """By bucket the logarithm of its frequency in the language that has it most; what no document has is rare, not impossible.

    Three bytes without a letter say nothing about a language, so they count as a bucket drawn at random.
    """
    means = [x[languages == c].mean(axis=0, dtype=np.float64) for c in sorted(set(languages))]
    out = np.log(np.max(means, axis=0) + 1e-6)
    out[trigrams(pa.array(["   "]))[0][0]] = -np.log(BUCKETS)
    return out


def shortfall(means: np.ndarray, middle, size: np.ndarray) -> np.ndarray:
    """How far the mean of `expected` over a text's trigrams is below that of its language, allowing more to short texts."""
    return (middle - means) / np.sqrt(1 + SHORT_BYTES / np.maximum(size, 1))


class Model:
    """The family decision and one decision per family, and what texts of the languages look like."""

    def __init__(self, x: np.ndarray, languages: np.ndarray, sizes: np.ndarray):
        # Each half of the sample is scored by the other. The level is twice as far from the middle as all but a hundredth of these.
        half, means = np.arange(len(x)) % 2 == 0, np.zeros(len(x))
        for learned in (half, ~half) if len(x) > 1 else ():
            means[~learned] = x[~learned] @ expected(x[learned], languages[learned])
        self.expected, self.middle, short = expected(x, languages), {}, [np.zeros(0)]
        for c in sorted(set(languages)):
            own = languages == c
            if own.sum() >= LEAST_HELD_OUT:
                self.middle[c] = float(np.median(means[own]))
                short.append(shortfall(means[own], self.middle[c], sizes[own]))
        short = np.concatenate(short)
        self.level = 2 * max(float(np.quantile(short, 0.99)), 0.1) if len(short) else np.inf
        # Buckets are scaled to equal spread; the scale is folded into the weights afterwards.
        scale = 1 / (x.std(axis=0) + 1e-4)
        scale = (scale / np.linalg.norm(x * scale, axis=1).mean()).astype(np.float32)
        x = x * scale
        family = np.array([FAMILY_OF.get(c, c) for c in languages], object)
        self.families = Votes(sorted(set(family)), x, family)
        self.within = [Votes(sorted(set(languages[family == f])), x[family == f], languages[family == f]) for f in self.families.classes]
        for part in self.parts():
            part.weights = part.weights * scale

    def parts(self) -> list[Votes]:
        return [self.families, *self.within]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """A model of the languages in `lang`, from at most `sample` documents with a text, equally many of each where there are enough.

    However many languages there are, each may have `LEAST_HELD_OUT` documents, so that each can have a middle. The sample is
    chosen by a hash of the key and of the text: equal rows count once, and rows without a key are told apart by their
    texts. Trigram frequencies of the sample are what reaches the driver.
    """
    named = docs.filter(F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    drawn = named.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("sample")).alias("draw"), F.col(text).alias("text"))
    sizes = {r[0]: r[1] for r in drawn.groupBy("lang").agg(F.approx_count_distinct("draw")).collect()}  # one row per language
    if not sizes:
        return None
    share = max(LEAST_HELD_OUT, sample // len(sizes))
    # Twice the share and forty more are drawn, so that as good as never too few are; the first of them in order of the draw are taken.
    part = F.lit(0)
    for code, n in sorted(sizes.items()):
        part = F.when(F.col("lang") == code, int(min(1.0, (2 * share + 40) / n) * (1 << 30))).otherwise(part) if n > 2 * share + 40 else part
    rare = [code for code, n in sizes.items() if n <= 2 * share + 40]
    chosen = (F.pmod("draw", F.lit(1 << 30)) < part) | F.col("lang").isin(rare)
    once = drawn.filter(chosen).groupBy("lang", "draw").agg(F.first("text").alias("text"))
    top = top_per(once, ["lang"], [F.col("draw")], share)

    def make():
        return lambda column: [pa.array([row.tobytes() for row in frequencies(column)], pa.binary())]

    rows = derive(top, [F.col("text")], [F.col("lang"), F.col("draw"), F.octet_length("text").alias("size")], "x binary", make).toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("draw", "ascending")])
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, BUCKETS)
    return Model(x, np.array(rows["lang"].to_pylist(), object), np.array(rows["size"].to_pylist()))


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str | Column] | None = None, known: bool = False) -> DataFrame:
    """The kept columns (all, if none are named) with `lang_pred` and `score`.

    With `known` also a column of that name: whether the text looks like those labelled with its language, by
    a level from the labelled sample's own held-out scores. A language with too few of these has no middle and
    all its texts are known; `und` is not.

    Texts that are null or hold no letter, and all texts without a model, are `und` with score 0.
    The score is the probability of the family times that of the language in it. Equal texts get
    equal answers. Input columns of the two names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def make():
        parts = model.parts() if model else []
        # All machines side by side; a score is the mean of a column over a text's trigrams.
        table = np.concatenate([p.weights for p in parts]).T.astype(np.float32) if parts else np.zeros((BUCKETS, 0), np.float32)
        if known and model:
            table = np.concatenate((table, model.expected[:, None].astype(np.float32)), axis=1)
        table = np.ascontiguousarray(table)
        begin = np.cumsum([0, *(len(p.pairs) for p in parts)])
        names = [p.classes for p in parts[1:]]

        def run(column, has_letter):
            usable = np.asarray(has_letter.to_pylist(), bool)
            n = len(usable)
            if model is None:
                return [pa.array([UNDETERMINED] * n), pa.array(np.zeros(n)), *[pa.array(np.zeros(n, bool))] * known]
            index, offsets = trigrams(column)
            means = np.zeros((n, table.shape[1]))
            for k in np.flatnonzero(usable):
                counts = np.bincount(index[offsets[k] : offsets[k + 1]], minlength=BUCKETS)
                means[k] = counts @ table / (offsets[k + 1] - offsets[k])
            family, chance = parts[0].decide(means[:, : begin[1]])
            out, score = [UNDETERMINED] * n, np.zeros(n)
            for f, part in enumerate(parts[1:]):
                rows = np.flatnonzero((family == f) & usable)
                best, inner = part.decide(means[rows][:, begin[f + 1] : begin[f + 2]])
                for r, c in zip(rows, best):
                    out[r] = names[f][c]
                score[rows] = chance[rows] * inner
            if not known:
                return [pa.array(out, pa.string()), pa.array(score)]
            middle = np.array([model.middle.get(c, -np.inf) for c in out])
            near = usable & (shortfall(means[:, -1], middle, np.diff(offsets)) <= model.level)
            return [pa.array(out, pa.string()), pa.array(score), pa.array(near)]

        return run

    return derive(docs, [keep.index(text) if text in [c for c in keep if isinstance(c, str)] else F.col(text), letters], [F.col(c) if isinstance(c, str) else c for c in keep], "lang_pred string, score double" + ", known boolean" * known, make)


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 4


def report(docs: DataFrame) -> DataFrame:
    """Predictions for every document from a model that has not seen a fourth of them."""
    learned = docs.filter(F.coalesce(fold() != 2, F.lit(True)))
    held_out = F.coalesce(fold() == 2, F.lit(False)).alias("held_out")
    return predict(docs, fit(learned), keep=["doc_id", held_out])
