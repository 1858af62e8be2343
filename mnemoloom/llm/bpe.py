"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can stand last in the prefix's
encoding: the one whose bytes end the prefix and that is compatible with the last token of what
precedes it. Two tokens are compatible if encoding their joined bytes gives the two back. One token
per prefix is therefore the whole state: appending bytes adds entries and changes none, and an edit
leaves every entry before it as it is.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import derive, worker_store

# Pieces whose ids a worker remembers; past it the memory starts anew.
MEMORY = 400_000
# Pairs of tokens whose fit a worker remembers.
PAIRS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64, a blank, its rank, line by line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with what the dynamic programme asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        # The longest token that ends in these two bytes.
        self.reach: dict[bytes, int] = {}
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            if len(token) > self.reach.get(token[-2:], 0):
                self.reach[token[-2:]] = len(token)
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self.known: dict[int, bool] = {}

    def merged(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Plain BPE: join the neighbours of lowest rank, the leftmost first, until none can be joined."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one edge of a token while it is merged, each with the rank of the merge that takes it up."""
        out, data, taken = [], self.bytes_of[token], sys.maxsize
        while True:
            out.append((data, taken))
            if len(data) == 1:
                return out
            taken, data = self.ranks[data], self.merged(data, 2)[side]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay side by side when their joined bytes are encoded.

        They do not if two parts that meet at the seam join before either is taken up by its own
        token. Of equal ranks the leftmost pair goes first: the left part is gone by then, the right
        one is still there.
        """
        a = self._right.get(left)
        if a is None:
            a = self._right[left] = self._edge(left, 1)
        b = self._left.get(right)
        if b is None:
            b = self._left[right] = self._edge(right, 0)
        ranks = self.ranks
        for x, x_taken in a:
            for y, y_taken in b:
                joined = ranks.get(x + y)
                if joined is not None and joined < x_taken and joined <= y_taken:
                    return False
        return True

    def follows(self, left: int, token: int) -> bool:
        """Whether the token can come next after `left` (-1: at the start). One that merging never gives can be no part."""
        if len(self.known) > PAIRS:
            self.known.clear()
        answer = len(self.merged(self.bytes_of[token])) == 1 and (left < 0 or self.fits(left, token))
        self.known[(left + 1) << 20 | token] = answer
        return answer


class Prefixes:
    """The encoding of every prefix of one piece: `last[j]` is the last token of the first j bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the piece; no earlier entry changes."""
        v, last = self.vocabulary, self.last
        at = len(self.data)
        data = self.data = self.data + more
        rank, known, reach = v.ranks.get, v.known.get, v.reach.get
        for j in range(at + 1, len(data) + 1):
            longest = reach(data[j - 2 : j], 1) if j > 1 else 1
            for i in range(j - longest if longest < j else 0, j):
                token = rank(data[i:j])
                if token is not None:
                    answer = known((last[i] + 1) << 20 | token)
                    if answer is None:
                        answer = v.follows(last[i], token)
                    if answer:
                        last.append(token)
                        break
            else:
                raise ValueError(f"byte {data[j - 1]} has no token")

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start to end; entries up to `start` are kept, the rest is computed anew."""
        tail = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new + tail)

    def ids(self) -> list[int]:
        at, out = len(self.data), []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[self.last[at]])
        return out[::-1]


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Ids of each piece. A piece that is itself a token is that token, as the rank libraries have it.

    A piece is an edit of the one before it from where they part, so sorted pieces share their prefixes.
    """
    state, out = Prefixes(vocabulary), []
    for piece in pieces:
        whole = vocabulary.ranks.get(piece)
        if whole is not None:
            out.append([whole])
            continue
        before = state.data
        same = next((k for k, (x, y) in enumerate(zip(before, piece)) if x != y), min(len(before), len(piece)))
        state.edit(same, len(before), piece[same:])
        out.append(state.ids())
    return out


def decode(vocabulary: Vocabulary, ids) -> bytes:
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids))


class Splitter:
    """The pieces of a text as the rank library's pattern cuts them.

    `regex` knows letters and digits that the library's own tables may not have yet. Code points on
    which `regex` and Python's tables differ are classed by the library, and stand-ins of that class
    take their places while the text is cut.
    """

    def __init__(self, pattern: str, unsettled: str):
        self.find = regex.compile(pattern).findall
        self.cut = regex.compile(pattern).finditer
        self.unsettled = regex.compile(unsettled)
        one = {bytes([i]): i for i in range(256)}
        self._is = {
            stand_in: tiktoken.Encoding(f"class {kind}", pat_str=rf"\p{{{kind}}}", mergeable_ranks=one, special_tokens={})
            for kind, stand_in in (("L", "a"), ("N", "1"))
        }

    def _settled(self, match) -> str:
        return next((c for c, library in self._is.items() if library.encode_ordinary(match[0])), "\x00")

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.unsettled.search(text):
                return [text[m.start() : m.end()] for m in self.cut(self.unsettled.sub(self._settled, text))]
        return self.find(text)


def unsettled_class() -> str:
    """A pattern for the code points that `regex` and Python's character tables class differently."""
    tests = [(regex.compile(rf"\p{{{kind}}}").match, kind) for kind in "LN"]
    spans: list[list[int]] = []
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind != "C" and c < 0x500 or 0xD800 <= c < 0xE000:
            continue
        if any(bool(match(chr(c))) != (kind == k) for match, k in tests):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]" if spans else r"(?!)"


def encoder(ranks: dict[bytes, int], pattern: str, key: str, unsettled: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian 32-bit integers; call it inside a task."""
    store = worker_store("bpe")
    if key not in store:
        store[key] = {}, Vocabulary(ranks), Splitter(pattern, unsettled)
    memory, vocabulary, split = store[key]

    def encode(texts: list[str]) -> list[bytes]:
        cut = [split(t) if t else [] for t in texts]
        wanted = set().union(*cut)
        new = sorted(p.encode() for p in wanted if p not in memory)
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = sorted(p.encode() for p in wanted)
        for piece, ids in zip(new, encode_pieces(vocabulary, new)):
            memory[piece.decode()] = np.asarray(ids, dtype="<u4").tobytes()
        return [b"".join(map(memory.__getitem__, pieces)) for pieces in cut]

    return encode


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if none are named), `ids` (binary, little-endian unsigned 32-bit) and `decoded` (binary).

    Whole texts; null counts as empty and gives no ids. Repeated rows stay repeated. Columns named
    `ids` or `decoded` in the input are replaced. Very long texts are encoded piece by piece.
    """
    keep = [c for c in docs.columns if c not in ("ids", "decoded")] if keep is None else keep
    unsettled = unsettled_class()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, fixed in size

    def make():
        encode = encoder(shared.value, pattern, key, unsettled)
        table = worker_store("bpe")[key][1].bytes_of

        def run(column):
            ids = encode(column.to_pylist())
            decoded = [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]
            return [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]

        return run

    return derive(docs, [keep.index(text) if text in keep else F.col(text)], [F.col(c) for c in keep], "ids binary, decoded binary", make)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str) -> DataFrame:
    """Per document: token count and the digests of its ids and of the bytes they decode to."""
    encoded = encode_texts(docs, ranks, pattern, key, keep=["doc_id"])
    return encoded.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
