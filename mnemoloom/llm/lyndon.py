"""Removal of repeated passages with suffix arrays built by linear grouping.

A suffix array is built in two phases. The first deals the suffixes into groups, from the highest group
down: for every suffix of a group the nearest smaller position before it (its previous-smaller pointer)
moves to a new group right above its old one, since its Lyndon prefix has grown by that of the group. The
second phase walks the finished array from its smallest suffix and puts what stands before each one,
and what the pointers lead to from there, to the front of its group. Nothing is renamed or recursed into.

No task holds the corpus, so equal windows are brought together first. Positions chosen by their bytes are
counted over all texts, and a window with a chosen gram that occurs once is no candidate. Candidate windows
are cut into pieces by their minimizer, the gram with the smallest hash: equal windows have the same one at
the same place. Pieces of one minimizer make a shard, each different piece once with its number of copies,
and the suffix array of the shard tells which of its windows repeat; its symbols are blocks of bytes counted from
the minimizer, which is at the same place in equal windows. A shard that is too large is dealt by
the offset of the minimizer in the window, half by half, and by the bytes that all windows of a half
share, so that its parts are small, alike or apart; nothing is dropped or capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import slices, utf8

U = np.uint64

WINDOW = 400
# One position in so many is chosen to tell candidates; its gram is a sixth of the window, a minimizer's a twelfth.
RATE = 32
# Bytes of different pieces whose suffixes are sorted in one shard.
SHARD_BYTES = 1 << 18
# Bytes of pieces whose shards are one task's: sorting takes some seconds a megabyte.
TASK_BYTES = 1 << 20
# Bytes that are one symbol of a shard's suffixes.
BLOCK = 8
# Bytes of text that a worker takes at a time.
SLICE_BYTES = 1 << 22


def suffix_order(codes: list[int]) -> list[int]:
    """Positions of a list in the order of its suffixes. Its last number must be smaller than all others."""
    n = len(codes)
    alphabet = {c: k for k, c in enumerate(sorted(set(codes)))}
    group = [alphabet[c] for c in codes]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(group):
        members[g].append(i)
    # Groups are a chain in ascending order; a member whose group has changed since is skipped where it still stands.
    lower, higher = list(range(-1, len(alphabet) - 1)), [*range(1, len(alphabet)), -1]
    smaller = list(range(-1, n - 1))  # previous-smaller pointers: of a finished suffix, the nearest unfinished one before it
    finished = bytearray(n)

    def above(g: int) -> int:
        """A new group right above another one."""
        new, h = len(members), higher[g]
        members.append([])
        lower.append(g)
        higher.append(h)
        higher[g] = lower[h] = new  # g is never the highest: its members wait for a higher group
        return new

    at = len(alphabet) - 1
    while at >= 0:
        mine = members[at]
        if len(mine) > 1:
            mine = members[at] = [i for i in mine if group[i] == at]
        elif mine and group[mine[0]] != at:
            mine = members[at] = []
        if len(mine) == 1:
            i = mine[0]
            finished[i] = 1
            p = smaller[i]
            while p >= 0 and finished[p]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                group[p] = above(group[p])
                members[-1].append(p)
            at = lower[at]
            continue
        for i in mine:
            finished[i] = 1
        reached: dict[int, int] = {}
        for i in mine:
            p = smaller[i]
            while p >= 0 and finished[p]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        # More of the group in a row is a higher Lyndon prefix; those of equal number keep their groups apart.
        numbers = set(reached.values())
        for times in sorted(numbers, reverse=True):
            split: dict[int, int] = {}
            for p in reached if len(numbers) == 1 else [p for p, k in reached.items() if k == times]:
                g = group[p]
                new = split.get(g)
                if new is None:
                    new = split[g] = above(g)
                group[p] = new
                members[new].append(p)
        at = lower[at]

    front, at, g = [0] * len(members), 0, 0
    while g >= 0:
        front[g] = at
        at += len(members[g])
        g = higher[g]
    order, placed = [n - 1] * n, bytearray(n)
    placed[n - 1] = 1
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            order[front[g]] = i
            front[g] += 1
            placed[i] = 1
            i = smaller[i]
    return order


def repeated_windows(texts: list[bytes], window: int, places: list[int] | None = None) -> list[np.ndarray]:
    """Of every text, which of its windows (by where they begin) stand somewhere else in the texts as well.

    With `places`, one of every text such that equal windows lie alike to it, the suffixes are those of blocks of bytes that are
    counted from there: equal windows hold equal whole blocks, so they are in one run of the order, and the bytes before and
    after these blocks tell them apart.
    """
    counts = [max(len(t) - window + 1, 0) for t in texts]
    if not sum(counts):
        return [np.zeros(c, bool) for c in counts]
    k = BLOCK if places is not None and window >= 2 * BLOCK else 1
    leads = [-p % k for p in places] if k > 1 else [0] * len(texts)
    sizes = np.array([-(-(lead + len(t)) // k) + 1 for lead, t in zip(leads, texts)])
    ends = np.cumsum(sizes) - 1
    begins = (ends + 1 - sizes) * k + leads
    joined = b"".join(b"\0" * lead + t + b"\0" * ((n - 1) * k - lead - len(t) + k) for lead, t, n in zip(leads, texts, sizes.tolist()))
    blocks = np.frombuffer(joined + b"\0" * (window // k * k), U if k > 1 else np.uint8)
    n = int(sizes.sum())
    codes = np.unique(blocks[:n], return_inverse=True)[1] + 2
    codes[ends] = 1
    order = np.asarray(suffix_order([*codes.tolist(), 0]))[1:]
    whole = np.zeros(n * k, bool)
    for b, c in zip(begins, counts):
        whole[b : b + c] = True
    again = np.zeros(n * k, bool)
    runs = {}
    for head in range(k):
        inside, tail = divmod(window - head, k)
        if inside not in runs:
            runs[inside] = _numbered(blocks, order, inside)
        at = order * k - head
        valid = at >= 0
        valid[valid] = whole[at[valid]]
        at, run, first = at[valid], runs[inside][valid], order[valid]
        keys = [run]
        if head:
            keys.append(blocks[first - 1] >> U(8 * (k - head)))
        if tail:
            keys.append(blocks[first + inside] & U((1 << 8 * tail) - 1))
        if len(keys) > 1:
            many = np.flatnonzero(np.bincount(run)[run] > 1)
            many = many[np.lexsort([x[many] for x in reversed(keys)])]
            at, keys = at[many], [x[many] for x in keys]
        same = np.logical_and.reduce([x[1:] == x[:-1] for x in keys])
        again[at[:-1][same]] = again[at[1:][same]] = True
    return [again[b : b + c] for b, c in zip(begins, counts)]


def _numbered(blocks: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the runs of suffixes, as ordered, that begin with `size` equal blocks."""
    rows = np.lib.stride_tricks.sliding_window_view(blocks, size)
    new = np.ones(len(order), np.int64)
    for k in range(0, len(order) - 1, 4096):
        a, b = order[k : k + 4097][:-1], order[k : k + 4097][1:]
        new[k + 1 : k + 1 + len(a)] = (rows[a] != rows[b]).any(axis=1)
    return np.cumsum(new) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out, filled = np.ones(max(n, 1), U), 1
    while filled < n:
        out[filled : 2 * filled] = out[: min(filled, n - filled)] * U(pow(base, filled, 1 << 64))
        filled *= 2
    return out


class Grams:
    """Hashes of all substrings of a given length. They only bring equal strings together; what differs is told by its bytes."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.back = _powers(_INVERSE, self.n)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[data] * _powers(_BASE, self.n)[: self.n])))

    def of(self, at: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[at + size] - self.sums[at]) * self.back[at])

    def all(self, size: int) -> np.ndarray:
        if self.n < size:
            return np.zeros(0, U)
        return _mix((self.sums[size:] - self.sums[: self.n - size + 1]) * self.back[: self.n - size + 1])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every run of `width` values."""
    out, size = x, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest, n = width - size, len(x) - width + 1
    return np.minimum(out[:n], out[rest : rest + n]) if n > 0 else x[:0]


class Cutter:
    """Chosen positions and pieces of the texts of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.offsets, self.window = data, offsets, window
        self.gram, self.anchor = max(window // 6, 1), max(window // 12, 1)
        self.grams = Grams(data)

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and hash of the gram of every chosen position of a text that has a window."""
        seed = min(16, self.gram)
        at = np.flatnonzero(self.grams.all(seed) % U(RATE) == 0)
        row = np.searchsorted(self.offsets, at, side="right") - 1
        inside = (at + self.gram <= self.offsets[row + 1]) & (np.diff(self.offsets) >= self.window)[row]
        at, row = at[inside], row[inside]
        return row, at, self.grams.of(at, self.gram)

    def pieces(self, single: np.ndarray):
        """(text, first byte, end, minimizer's place, its hash) of every piece; no window holds the gram of a `single` position."""
        n = len(self.data) - self.window + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),)
        free = np.zeros(len(self.data) + 1, np.int64)
        first = np.maximum(single - (self.window - self.gram), 0)
        free += np.bincount(first, minlength=len(free)) - np.bincount(single + 1, minlength=len(free))
        candidate = np.cumsum(free)[:n] == 0
        row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))[:n]
        candidate &= np.arange(n) + self.window <= self.offsets[row + 1]
        start = np.flatnonzero(candidate)
        if not len(start):
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),)
        hashes = self.grams.all(self.anchor)
        # The upper half of the hash, then the place: of equal ones the first.
        least = _least((hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U), self.window - self.anchor + 1)
        at = (least[start] & U(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(start)) - 1
        return row[start[head]], start[head], start[last] + self.window, at[head], hashes[at[head]]


def _name(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _key(text: Column) -> Column:
    """128 bits that name a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _samples(docs: DataFrame, window: int) -> DataFrame:
    """`h`, `t`, `n`: grams at chosen positions, the hash of their text, and how often they are chosen in it."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                data, offsets = utf8(part.column(1))
                row, _, h = Cutter(data, offsets, window).chosen()
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(row)))
                t = np.asarray(part.column(0))[row[head]]
                yield pa.RecordBatch.from_arrays([pa.array(h[head].astype(np.int64)), pa.array(t, pa.int64()), pa.array(n, pa.int64())], names=["h", "t", "n"])

    return docs.select("t", "text").mapInArrow(run, "h bigint, t bigint, n bigint")


def _pieces(docs: DataFrame, window: int) -> DataFrame:
    """Where the pieces of every text (`id`, `text`, `known`: hashes of chosen grams that repeat) lie.

    `times` pieces of one window each that follow each other byte by byte and are alike (in a run of one letter) are one row.
    Copies of a text in a slice are cut once, and `docs` is their number.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                copies = part.column(0).dictionary_encode().indices
                head, docs_of = np.unique(np.asarray(copies), return_index=True, return_counts=True)[1:]
                if len(head) < len(copies):
                    part = part.take(pa.array(head))
                data, offsets = utf8(part.column(1))
                cutter = Cutter(data, offsets, window)
                row, at, h = cutter.chosen()
                known = part.column(2)
                owner = np.repeat(np.arange(len(known)), np.asarray(known.value_lengths().fill_null(0)))
                told = np.asarray(known.flatten()).astype(np.int64).view(U)
                # A gram is known if its hash is listed for its own text.
                names, number = np.unique(np.concatenate((told, h)), return_inverse=True)
                listed, asked = owner * len(names) + number[: len(told)], row * len(names) + number[len(told) :]
                row, first, end, place, anchor = cutter.pieces(at[~np.isin(asked, listed)])
                whole = data.tobytes()
                names = [_name(whole[a:b]) for a, b in zip(first.tolist(), end.tolist())]
                # Single windows that follow each other and are alike.
                both = np.frombuffer(b"".join(names), U).reshape(-1, 2)
                new = np.ones(len(first), bool)
                new[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1) | (end - first != window)[1:] | (end - first != window)[:-1] | (both[1:] != both[:-1]).any(axis=1)
                head = np.flatnonzero(new)
                times = np.diff(np.append(head, len(first)))
                row, first, end, place, anchor = (x[head] for x in (row, first, end, place, anchor))
                r, start, size, key, off = row, first - offsets[row], end - first, anchor.astype(np.int64), place - first
                name = [names[k] for k in head.tolist()]
                ids = part.column(0).take(pa.array(r, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, pa.int64()) for c in (start, size, times, key, off)), pa.array(name, pa.binary()), pa.array(docs_of[r], pa.int64())],
                    names=["id", "start", "size", "times", "key", "off", "piece", "docs"],
                )

    return docs.select("id", "text", "known").mapInArrow(run, "id binary, start bigint, size bigint, times bigint, key bigint, off bigint, piece binary, docs bigint")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`piece` and `text` (its bytes) of the pieces (`piece`, `id`, `start`, `size`), each once per batch at least."""
    # Written, so that the join stands on shuffles alone and a crowd of copies is split.
    lists = stored(wanted.groupBy("id").agg(F.collect_list(F.struct("start", "size", "piece")).alias("wanted")))

    def run(batches):
        for batch in batches:
            done, names, texts = set(), [], []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                for w in wanted.as_py():
                    if w["piece"] not in done:
                        done.add(w["piece"])
                        names.append(w["piece"])
                        texts.append(raw[w["start"] : w["start"] + w["size"]])
                if sum(map(len, texts)) > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.binary())], names=["piece", "text"])
                    names, texts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.binary())], names=["piece", "text"])

    return docs.join(lists, "id").select("text", "wanted").mapInArrow(run, "piece binary, text binary").distinct()


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _search(shards: DataFrame, window: int, tasks: int) -> DataFrame:
    """`piece`, `a`, `b`: ranges of the windows of every piece (`key`, `piece`, `text`, `off`) that repeat in its shard."""
    rows = shards.select("key", "piece", "text", "off").repartition(tasks, "key").sortWithinPartitions("key")

    def told(names, texts, places):
        out = [(name, int(a), int(b)) for name, flags in zip(names, repeated_windows(texts, window, places)) for a, b in zip(*_runs(flags))]
        name, a, b = zip(*out) if out else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["piece", "a", "b"])

    def run(batches):
        key, names, texts, places = None, [], [], []
        for batch in batches:
            for k, name, text, off in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if k != key:
                    if len(names) > 1:
                        yield told(names, texts, places)
                    key, names, texts, places = k, [], [], []
                names.append(name)
                texts.append(text)
                places.append(off)
        if len(names) > 1:
            yield told(names, texts, places)

    return rows.mapInArrow(run, "piece binary, a bigint, b bigint")


def _halves(pieces: DataFrame, window: int) -> DataFrame:
    """Every piece (`piece`, `text`, `off`, `copies`, `low`, `high`: offsets of the minimizer in its windows) cut in the middle of these.

    `key` is the hash of the bytes that all windows of the half share, `whole` the piece and `skip` where the part begins in it.
    """
    fields = "whole binary, skip bigint, key bigint, piece binary, text binary, off bigint, copies bigint, low bigint, high bigint"

    def run(batches):
        for batch in batches:
            out = []
            for name, text, off, copies, low, high in zip(*(batch.column(k).to_pylist() for k in range(6))):
                middle = (low + high) // 2
                for x, y in ((low, middle), (middle, high)):
                    first, last = max(off - (y - 1), 0), min(off - x, len(text) - window)
                    if first > last or x == y:
                        continue
                    part = text[first : last + window]
                    shared = text[off - x : off - (y - 1) + window]
                    key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=x.to_bytes(8, "little")).digest(), "little", signed=True)
                    out.append((name, first, key, _name(part), part, off - first, copies, x, y))
            columns = list(zip(*out)) if out else [()] * 9
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["whole", "skip", "key", "piece", "text", "off", "copies", "low", "high"])

    return pieces.select("piece", "text", "off", "copies", "low", "high").mapInArrow(run, fields)


def _open(classes: DataFrame) -> DataFrame:
    """Shards (`key`, `bytes`) with different pieces, one of which has no copy: all others are settled by their numbers of copies."""
    groups = classes.groupBy("key").agg(F.count("*").alias("n"), F.min("copies").alias("least"), F.sum(F.col("size") + 1).alias("bytes"))
    return groups.filter("n > 1 and least = 1").select("key", "bytes")


def repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`id` and `spans` (first byte, end; in any order, they may overlap) of the texts (`id`, `text`, `t`: a hash of it) that
    hold a window which begins at another place as well, in the same or another text or a copy of it."""
    counted = _samples(docs, window).groupBy("h").agg(F.sum("n").alias("n"))
    again = stored(counted.filter("n > 1").select("h"))
    known = _samples(docs, window).select("h", "t").join(again, "h").groupBy("t").agg(F.collect_set("h").alias("known"))
    known = stored(known)
    # Copies of a text give the same rows: they are counted and not kept.
    raw = _pieces(docs.filter(F.octet_length("text") >= window).join(known, "t", "left"), window)
    places = stored(raw.groupBy(*[c for c in raw.columns if c != "docs"]).agg(F.sum("docs").alias("docs")))
    classes = places.groupBy("piece").agg(
        F.sum(F.col("times") * F.col("docs")).alias("copies"), F.first("key").alias("key"), F.first("off").alias("off"), F.first("size").alias("size"),
        F.min(F.struct("id", "start")).alias("at"),
    )
    classes = stored(classes)
    found = [classes.filter("copies > 1").select("piece", F.lit(0).cast("bigint").alias("a"), (F.col("size") - window + 1).alias("b"))]
    shards = stored(_open(classes))
    wanted = classes.join(shards.select("key"), "key")
    texts = _texts(docs, wanted.select("piece", "at.id", "at.start", "size"))
    anchor = max(window // 12, 1)
    pieces = wanted.join(texts, "piece").select("key", "piece", "text", "off", "copies", F.lit(0).cast("bigint").alias("low"), F.lit(window - anchor + 1).cast("bigint").alias("high"))
    pieces, roots = stored(pieces), None
    while True:
        small = shards.filter(F.col("bytes") <= shard_bytes)
        tasks = -(-(small.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES) or 1
        hits = _search(pieces.join(small.select("key"), "key"), window, tasks)
        if roots is not None:
            hits = hits.join(roots, "piece").select(F.col("root").alias("piece"), (F.col("a") + F.col("skip")).alias("a"), (F.col("b") + F.col("skip")).alias("b"))
        found.append(hits)
        large = shards.filter(F.col("bytes") > shard_bytes).select("key")
        if large.isEmpty():
            break
        cut = stored(_halves(pieces.join(large, "key"), window))
        links = cut.select("whole", "skip", "piece")
        if roots is not None:
            old = roots.select(F.col("piece").alias("whole"), "root", F.col("skip").alias("before"))
            links = links.join(old, "whole").select("root", (F.col("skip") + F.col("before")).alias("skip"), "piece")
        else:
            links = links.withColumnRenamed("whole", "root")
        roots = stored(links.distinct())
        of_piece = ["key", "piece", "text", "off", "low", "high"]
        pieces = cut.groupBy(*of_piece).agg(F.sum("copies").alias("copies")).withColumn("size", F.octet_length("text").cast("bigint"))
        pieces = stored(pieces)
        all_of = pieces.filter("copies > 1").join(roots, "piece")
        found.append(all_of.select(F.col("root").alias("piece"), F.col("skip").alias("a"), (F.col("skip") + F.col("size") - window + 1).alias("b")))
        shards = stored(_open(pieces))
        pieces = pieces.drop("size")
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    spans = places.join(hits.distinct(), "piece").select("id", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + F.col("times") - 1 + window - 1).alias("b")).alias("span"))
    return spans.groupBy("id").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The kept columns (all but the text, if none are named), `kept` (the remaining bytes) and `removed` (runs taken out: first byte, end).

    A byte goes if a window of so many bytes that covers it begins at another place too, in any text or in
    the same one; overlapping places count, and all windows are judged on the input. Null and empty texts, and those
    shorter than a window, lose nothing. Repeated rows are copies of each other, so each loses
    what its windows cover. Keys are not looked at: they may be null, repeated or missing. Input
    columns named `kept` or `removed` are replaced.
    """
    names = [c for c in docs.columns if c not in (text, "kept", "removed")] if keep is None else keep
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    work = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"), value.alias("text"), _key(value).alias("id"))
    source = work.select("id", "text", F.xxhash64("text").alias("t"))
    spans = stored(repeats(source, window, shard_bytes))
    joined = work.join(spans, "id", "left").select("row", "text", "spans")
    fields = joined.select("row").schema[0].dataType

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                kept, removed = [], []
                for t, spans in zip(part.column(1), part.column(2)):
                    raw, runs = t.as_py().encode(), []
                    if spans.is_valid:
                        cover = np.zeros(len(raw) + 1, np.int32)
                        a, b = (spans.values.field(k).to_numpy() for k in range(2))
                        np.add.at(cover, a, 1)
                        np.add.at(cover, b, -1)
                        gone = np.cumsum(cover)[:-1] > 0
                        runs = [{"first": int(x), "end": int(y)} for x, y in zip(*_runs(gone))]
                        raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    kept.append(raw)
                    removed.append(runs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                    names=["row", "kept", "removed"],
                )

    out = joined.mapInArrow(run, f"row {fields.simpleString()}, kept binary, removed array<struct<first: bigint, end: bigint>>")
    return out.select(*[F.col("row").getField(f"c{k}").alias(c) for k, c in enumerate(names)], "kept", "removed")


def report(docs: DataFrame) -> DataFrame:
    """Per document: its bytes, those removed, the runs they form, and a digest of what is kept."""
    out = remove_repeats(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes")))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r.end - r.first)
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
