"""Jaccard self-join of word n-gram sets with PartEnum signatures.

A set is partitioned by the bits of its members' hashes, again and again, until a part is in the size
band of a leaf. Of the parts of two sets with Jaccard similarity g or more at least one is at least as
similar (the similarity of the whole is a mean of those of its parts), and so on down, so both sets
reach a leaf in which they differ in no member (sizes of the lowest band) or in one. In a leaf that
may differ in k members the members are partitioned once more, in k + 2 ways, and every choice of 2 of
these is a signature: one difference leaves two of the three alike. Leaves whose size lies between
bands take part in both. Sets sharing no signature are not similar, so nothing is lost.

Sets sharing a signature are linked to the smallest of them as candidates, checked exactly on the
whole texts, and joined into components; what still shares a signature across components is then
checked pair by pair. Copies of a set count as one throughout. Similar sets are in one component, so
links are counted by comparing the sets of every component with each other, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import discard, stored
from .common import SLICE_BYTES, derive, slices, utf8, word_spans
from .components import components

U = np.uint64

# All but the six white-space characters of ASCII; A-Z in lower case.
IS_WORD = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all of it."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# Rounds in which the components that share a signature meet one of its sets, before they meet each other.
STAR_ROUNDS = 2
# Sets and shingles of one block of a component, when its links are counted.
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1 << 20

_BYTE = _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U)
    filled = 1
    while filled < n:
        step = U(pow(base, filled, 1 << 64))
        out[filled : 2 * filled] = out[: min(filled, n - filled)] * step
        filled *= 2
    return out


def shingle_sets(column, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text as ascending 64-bit hashes, and where each text's begin.

    A text of fewer words is one shingle of all of them; one without words has none.
    """
    data, offsets = utf8(column)
    n = len(offsets) - 1
    start, end, row = word_spans(data, offsets, IS_WORD)
    if not len(start):
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    power = _powers(_BASE, len(data) + 1)
    back = _powers(_INVERSE, len(data) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)])))
    word = _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U))
    per_row = np.bincount(row, minlength=n)
    first = np.cumsum(per_row) - per_row
    size = np.minimum(per_row, n_words)
    count = np.where(per_row > 0, per_row - size + 1, 0)
    total = int(count.sum())
    begin = np.cumsum(count) - count
    at = np.repeat(first - begin, count) + np.arange(total)
    length = np.repeat(size, count)
    shingle = np.zeros(total, U)
    for k in range(n_words):
        here = length > k
        shingle[here] = _mix(shingle[here] * U(3) + word[at[here] + k] + U(k + 1))
    ends = np.append(begin, total)
    for k in np.flatnonzero(count > 1):
        shingle[ends[k] : ends[k + 1]].sort()
    owner = np.repeat(np.arange(n), count)
    fresh = np.ones(total, bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[fresh], minlength=n)
    return shingle[fresh], np.concatenate(([0], np.cumsum(sizes)))


def sliced_sets(column, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """`shingle_sets`, of a bounded number of bytes at a time."""
    found = [shingle_sets(b.column(0), n_words) for b in slices(pa.RecordBatch.from_arrays([column], ["text"]), 0, SLICE_BYTES)]
    sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(at) for _, at in found)])
    return np.concatenate([np.zeros(0, U), *(sets for sets, _ in found)]), np.cumsum(sizes)


@dataclass(frozen=True)
class Bands:
    """What the sizes of two parts allow, for a similarity of num / den or more."""

    num: int
    den: int

    def __post_init__(self):
        if self.num * 2 <= self.den or self.num > self.den:
            raise ValueError("the similarity must be above 1/2 and at most 1")

    def differ(self, total: int) -> int:
        """Most members in which two parts of so many together may differ; -1 if they cannot be similar."""
        fitting = (d for d in range(total % 2, total + 1, 2) if (total - d) * self.den >= (total + d) * self.num)
        return max(fitting, default=-1)

    def partners(self, a: int) -> range:
        return range(-(-a * self.num // self.den), a * self.den // self.num + 1)

    def level(self, a: int) -> int:
        return max(self.differ(a + b) for b in self.partners(a))

    @property
    def leaf(self) -> int:
        """The largest size whose parts differ in one member at most."""
        a = 1
        while self.level(a + 1) <= 1:
            a += 1
        return a

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """By size up to the largest partner of a leaf: whether it signs as a whole, and whether in subsets."""
        top = self.leaf * self.den // self.num
        whole, subsets = np.zeros(top + 1, bool), np.zeros(top + 1, bool)
        for a in range(1, top + 1):
            levels = {self.level(b) for b in self.partners(a) if 1 <= b <= self.leaf}
            levels = {x for x in levels if a > self.leaf or x <= self.level(a)}
            whole[a], subsets[a] = 0 in levels, 1 in levels
        return whole, subsets


def signatures(sets: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of every set, and the number of the set each belongs to."""
    whole, subsets = bands.table()
    leaf, top = bands.leaf, len(whole) - 1
    h, owner = sets, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out, owners = [], []
    depth = 0
    while len(h):
        path = h >> U(64 - depth) if depth else np.zeros(len(h), U)
        new = np.ones(len(h), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        cell = np.repeat(np.arange(len(first)), size)
        name = _mix(path[first] * U(64) + U(depth))
        small = np.minimum(size, top)
        ends = size <= top
        sums = np.add.reduceat(_mix(h ^ U(0x5851F42D4C957F2D)), first)
        pick = ends & whole[small]
        out.append(_mix(sums[pick] ^ name[pick]))
        owners.append(owner[first][pick])
        pick = ends & subsets[small]
        members = pick[cell]
        _subsets(h[members], np.cumsum(pick)[cell[members]] - 1, name[pick], owner[first][pick], out, owners)
        deeper = (size > leaf)[cell]
        h, owner = h[deeper], owner[deeper]
        depth += 1
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owners)


def _subsets(h, cell, name, owner, out, owners) -> None:
    """Two of three sub-partitions of every leaf; a leaf that lies in one of them alone is dealt anew as well."""
    seed = 0
    while len(name):
        value = _mix(h + U(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF))
        third = (value >> U(32)) % U(3)
        sums = [np.bincount(cell[third == U(k)], minlength=len(name)) for k in range(3)]
        hashes = []
        for k in range(3):
            part = np.zeros(len(name), U)
            np.add.at(part, cell[third == U(k)], value[third == U(k)])
            hashes.append(part)
        again = np.zeros(len(name), bool)
        for left_out in range(3):
            i, j = (k for k in range(3) if k != left_out)
            some = sums[i] + sums[j] > 0
            again |= ~some
            out.append(_mix(_mix(hashes[i][some] + U(i + 1)) ^ (hashes[j][some] * U(5) + name[some] + U(8 * seed + left_out))))
            owners.append(owner[some])
        kept = again[cell]
        h, cell = h[kept], np.cumsum(again)[cell[kept]] - 1
        name, owner, seed = name[again], owner[again], seed + 1


def _names(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set; empty ones get 0. Equal sets, equal names."""
    size = np.diff(offsets)
    names = np.zeros(len(size), U)
    some = size > 0
    if some.any():
        names[some] = _mix(np.add.reduceat(_mix(sets ^ U(0xD6E8FEB86659FD93)), offsets[:-1][some]) + size[some].astype(U))
    return names.astype(np.int64)


def _parities(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """512 bits per set: whether an odd number of its members falls into each of so many parts.

    A member that only one of two sets has turns one bit, so sets differ in no fewer members than their parities in bits.
    """
    n = len(offsets) - 1
    part = (_mix(sets + U(0xA0761D6478BD642F)) >> U(55)).astype(np.int64)
    out = np.zeros((n, 8), np.int64)
    for at in range(0, n, 4096):
        end = min(n, at + 4096)
        rows = np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1]))
        odd = np.bincount(rows * 512 + part[offsets[at] : offsets[end]], minlength=(end - at) * 512) & 1
        out[at:end] = np.packbits(odd.astype(bool).reshape(end - at, 512), axis=1).view(np.int64)
    return out


def set_names(docs: DataFrame, n_words: int) -> DataFrame:
    """`id`, `mark`, `n` (size of its set), `cls` (name of its set) and `odd` (its parities) per row of (`id`, `text`).

    The mark tells rows with the same id and different texts apart.
    """

    def make():
        def run(column):
            sets, offsets = shingle_sets(column, n_words)
            odd = pa.FixedSizeListArray.from_arrays(pa.array(_parities(sets, offsets).reshape(-1)), 8).cast(pa.list_(pa.int64()))
            return [pa.array(np.diff(offsets), pa.int64()), pa.array(_names(sets, offsets), pa.int64()), odd]

        return run

    return derive(docs, [F.col("text")], [F.col("id"), F.xxhash64("text").alias("mark")], "n bigint, cls bigint, odd array<bigint>", make)


def _may_be_similar(x: str, y: str, num: int, den: int):
    """What sizes and parities of two sets (columns x.n, x.odd, y.n, y.odd) leave possible."""
    differ = " + ".join(f"bit_count({x}.odd[{i}] ^ {y}.odd[{i}])" for i in range(8))
    # (total - d) / (total + d) >= num / den for d members in which they differ
    return F.expr(f"{x}.n * {den} >= {y}.n * {num} and {y}.n * {den} >= {x}.n * {num} and ({differ}) * {num + den} <= ({x}.n + {y}.n) * {den - num}")


def signed(docs: DataFrame, n_words: int, bands: Bands) -> DataFrame:
    """(`home`, `cls`, `lead`, `sig`): every signature once per batch, under itself; and for others of the batch that share it a row
    under a name of its own, with the set that stands for them and the signature. What is null takes no room in the shuffle.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            sets, offsets = shingle_sets(batch.column(0), n_words)
            names = _names(sets, offsets)
            # Copies within the batch sign once.
            first = np.unique(names, return_index=True)[1]
            one = np.zeros(len(names), bool)
            one[first] = True
            keep = np.repeat(one, np.diff(offsets))
            size = np.where(one, np.diff(offsets), 0)
            sig, owner = signatures(sets[keep], np.concatenate(([0], np.cumsum(size))), bands)
            sig, cls = sig.astype(np.int64), names[owner]
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            head = np.ones(len(sig), bool)
            head[1:] = sig[1:] != sig[:-1]
            lead = cls[np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))] if len(sig) else cls
            rows = np.flatnonzero(head | (lead != cls))
            rows = rows[np.argsort(cls[rows], kind="stable")]  # equal values in a row take less room in the shuffle
            sig, cls, lead, head = sig[rows], cls[rows], lead[rows], head[rows]
            own = _mix(sig.astype(U) ^ _mix(cls.astype(U))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(head, sig, own)), pa.array(cls), pa.array(lead, mask=head), pa.array(sig, mask=head)], names=["home", "cls", "lead", "sig"]
            )

    return docs.select("text").mapInArrow(run, "home bigint, cls bigint, lead bigint, sig bigint")


def check(pairs: DataFrame, texts: DataFrame, n_words: int, num: int, den: int, crowd: int = 256) -> DataFrame:
    """Those of the pairs (`a`, `b`) of set names that are similar, by the whole texts (`cls`, `text`).

    A set meets its partners in groups of `crowd`, each of which it heads, so a popular one is
    spread over tasks; a task holds one head and one batch at a time.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(crowd)).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"))
    rows = members.union(heads).join(texts.withColumnRenamed("cls", "b"), "b").select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))

    def run(batches):
        head, head_set = None, None
        for batch in (part for whole in batches for part in slices(whole, 3, SLICE_BYTES)):
            a, part, b = (np.asarray(batch.column(i)) for i in range(3))
            sets, offsets = shingle_sets(batch.column(3), n_words)
            left, right = [], []
            for k in range(len(a)):
                mine = sets[offsets[k] : offsets[k + 1]]
                if a[k] == b[k]:
                    head, head_set = (a[k], part[k]), mine
                elif (a[k], part[k]) == head:
                    small, large = len(mine), len(head_set)
                    if min(small, large) * den < max(small, large) * num:
                        continue
                    both = np.concatenate((mine, head_set))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if common * den >= (small + large - common) * num:
                        left.append(a[k])
                        right.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _similar(sets: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the sets `x` (rows) are similar to which of the sets `y` (columns): exactly, all pairs."""
    n = np.diff(offsets)
    nx, ny = n[x][:, None], n[y][None, :]
    near = (np.minimum(nx, ny) * den >= np.maximum(nx, ny) * num) & (np.minimum(nx, ny) > 0)
    bits = _parities(sets, offsets).view(U)
    differ = np.zeros(near.shape, np.int64)
    for k in range(bits.shape[1]):
        differ += np.bitwise_count(bits[x, k][:, None] ^ bits[y, k][None, :])
    near &= differ * (num + den) <= (nx + ny) * (den - num)
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return near
    # Members of the sets that are left, numbered; what only one set has is in no intersection.
    used = np.zeros(len(n), bool)
    used[x[rows]] = used[y[columns]] = True
    pick = np.repeat(used, n)
    _, number, times = np.unique(sets[pick], return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)[pick]
    shared = times > 1
    owner, number = owner[shared[number]], (np.cumsum(shared) - 1)[number[shared[number]]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    at = np.full(len(n), -1)
    at[used] = np.arange(used.sum())
    common = np.zeros((len(rows), len(columns)), np.float64)
    step = 4096
    for begin in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(number, (begin, begin + step))
        part = np.zeros((int(used.sum()), step), np.float32)  # sums of at most 4,096 ones are exact
        part[at[owner[a:b]], number[a:b] - begin] = 1
        common += part[at[x[rows]]] @ part[at[y[columns]]].T
    total = nx[rows] + ny[:, columns]
    near[np.ix_(rows, columns)] &= common * den >= (total - common) * num
    return near


def link_counts(found: DataFrame, classes: DataFrame, texts: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """`cls` and `others`: how many rows with another, similar set there are, for the sets (`node`) of the components.

    A component is dealt into blocks; every two of them, and each with itself, are compared in one task,
    which returns a count per set. So no pair is written, and a large component is spread over tasks.
    """
    of = found.withColumnRenamed("node", "cls").join(classes.select("cls", "n", "copies"), "cls")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    rows = of.join(of.groupBy("component").agg(blocks.alias("blocks")), "component")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.select("component", "cls", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "copies")
    rows = rows.join(texts, "cls").select("component", "i", "j", "block", "cls", "copies", "text")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def count(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        i, j, block, cls, copies = (np.asarray(rows[c].combine_chunks()) for c in ("i", "j", "block", "cls", "copies"))
        sets, offsets = sliced_sets(rows["text"].combine_chunks(), n_words)
        x, y = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        near = _similar(sets, offsets, x, y, num, den)
        if i[0] == j[0]:
            np.fill_diagonal(near, False)
            node, n = cls[x], near @ copies[y]
        else:
            node, n = np.concatenate((cls[x], cls[y])), np.concatenate((near @ copies[y], copies[x] @ near))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64())], names=["cls", "n"])

    def run(batches):
        waiting, key = [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
            first = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip((0, *first), (*first, len(keys))):
                if a == b:
                    continue
                if waiting and tuple(keys[a]) != key:
                    yield count(waiting)
                    waiting = []
                key = tuple(keys[a])
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield count(waiting)

    return rows.mapInArrow(run, "cls bigint, n bigint").groupBy("cls").agg(F.sum("n").alias("others"))


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = 5, num: int = 4, den: int = 5, links: bool = False) -> DataFrame:
    """`id`, `n_shingles`, `component_id` and `mark` per row: the smallest id that is reachable by links between similar sets.

    With `links` also `n_links`: the number of other rows that the row is linked to, copies among them.

    Two rows are linked if the Jaccard similarity of their shingle sets is num / den or more. Rows
    without words (null and empty texts) have no shingles and are linked with nothing, each its own
    component; a null key is returned as it is and counts as smaller than none. Repeated rows are
    copies of each other. Texts are read whole. Members and sets are compared by 64-bit hashes.
    """
    return _placed_rows(docs, key, text, n_words, num, den, links).drop("component")


def _placed_rows(docs: DataFrame, key: str, text: str, n_words: int, num: int, den: int, links: bool = False) -> DataFrame:
    """The columns of `similar_components`, and `component`: a name that rows share if and only if they are linked, whatever their ids; null without words."""
    bands = Bands(num, den)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    named = stored(set_names(docs, n_words))
    # `at` is the row whose text stands for the set: ids repeat and may be null, with its mark one names a text.
    classes = named.filter("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.min(F.struct("id", "mark")).alias("at"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.count("*").alias("copies"))
    classes = stored(classes)

    rows = signed(docs, n_words, bands)
    rows = rows.withColumn("least", F.min("cls").over(W.partitionBy("home"))).filter("lead is not null or least <> cls")
    shared = stored(rows.select(F.coalesce("sig", "home").alias("sig"), "cls", F.coalesce("lead", "least").alias("other")))
    involved = shared.select("cls").union(shared.select("other")).distinct()
    reps = classes.join(involved, "cls").select("cls", "at.id", "at.mark")
    here = docs.select("id", "text", F.xxhash64("text").alias("mark"))
    texts = here.join(reps, here["id"].eqNullSafe(reps["id"]) & (here["mark"] == reps["mark"])).select("cls", "text")
    texts = stored(texts.dropDuplicates(["cls"]))
    about = classes.select("cls", F.struct("cls", "n", "odd").alias("set"))
    members = shared.select("sig", "cls").union(shared.select("sig", F.col("other").alias("cls"))).distinct()
    members = stored(members)

    # First every set with the one it shares most signatures with, of those that stand for a signature.
    counted = shared.groupBy(F.col("cls").alias("b"), F.col("other").alias("a")).agg(F.count("*").alias("k"))
    best = counted.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a"))
    best = best.join(about.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(about.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    first = check(best.filter(_may_be_similar("x", "y", num, den)).select("a", "b"), texts, n_words, num, den)
    found = stored(components(first))
    discard(shared)

    # Then, under every signature that several components share, one set of each with one that stands for all;
    # after some such rounds whatever is left, pair by pair.
    for turn in range(STAR_ROUNDS + 1):
        placed = stored(_placed(members, found))  # read twice
        left = stored(_apart(placed).join(about, "cls"))
        discard(placed)
        if turn < STAR_ROUNDS:
            draw = F.xxhash64("cls", F.lit(turn))
            x = left.groupBy("sig").agg(F.min_by(F.struct("set", "component"), draw).alias("lead")).select("sig", "lead.*")
            y = left.groupBy("sig", "component").agg(F.min_by("set", draw).alias("set"))
            order = F.lit(True)
        else:
            x, y = left, left
            order = F.col("x.set.cls") < F.col("y.set.cls")
        near = _may_be_similar("x.set", "y.set", num, den)
        pairs = x.alias("x").join(y.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.component") != F.col("y.component")) & order & near)
        pairs = stored(pairs.select(F.col("x.set.cls").alias("a"), F.col("y.set.cls").alias("b")).distinct())
        discard(left)
        new = stored(check(pairs, texts, n_words, num, den))
        discard(pairs)
        if new.isEmpty():
            continue  # nothing has moved
        found = stored(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)))

    discard(members, *([] if links else [texts]))
    small = found.withColumnRenamed("node", "cls").join(classes, "cls").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = found.withColumnRenamed("node", "cls").join(small, "component").select("cls", "component_id", "component")
    known = classes.join(of_class, "cls", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("component", "cls").alias("component"), "copies")
    if links:
        known = known.join(link_counts(found, classes, texts, n_words, num, den), "cls", "left")
        known = known.withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    out = named.join(known, "cls", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"), "mark", "component", *[F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")] * links)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of `docs` that stay if one of each component does: that with the smallest key, of repeated rows one.

    Texts without words are near to nothing and stay, as do different texts with the same key unless they
    are near each other. A null key stays only where no other key is in its component.
    """
    told = _placed_rows(docs, key, text, n_words, num, den)
    # Of different texts with one key in one component the one with the smallest mark stays; those without words all do.
    best = told.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("at"))
    chosen = best.select("at.id", "at.mark").union(told.filter("n_shingles = 0").select("id", "mark").distinct())
    chosen = chosen.select(F.col("id").alias("k"), F.col("mark").alias("m"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), row.alias("row"))
    one = rows.join(chosen, rows["id"].eqNullSafe(chosen["k"]) & (rows["mark"] == chosen["m"])).groupBy("id", "mark").agg(F.first("row").alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """`sig`, `cls`, `component` of every member of a signature; a set that is in no component is its own."""
    placed = members.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left")
    return placed.withColumn("component", F.coalesce("component", "cls"))


def _apart(placed: DataFrame) -> DataFrame:
    """Those of the members of signatures that more than one component shares."""
    split = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sig")
    return placed.join(split, "sig")
