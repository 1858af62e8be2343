"""Token counts of huge texts: overlapping chunks, joined where both sides agree on a proven boundary.

A position after a letter, a digit or ASCII punctuation and before a blank or a line feed is a
boundary whatever surrounds it: no match of a byte-level splitting pattern holds a blank after
another character, and what follows is cut the same from there on. Two chunks that both have a token
ending at such a position in their overlap are spliced there; if there is none, the overlap is
doubled, up to the rest of the text.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import derive, worker_store

CHUNK, OVERLAP = 1 << 16, 1 << 10
MEMORY = 500_000

# The pattern that the library's byte-level splitter uses; a fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters whose class is the same in every version of the character tables.
SETTLED = re.compile("[^\x00-ɏ–-„…€]")


class Encoder:
    """Where the tokens of a chunk end, as the library has them.

    If the library cuts by the byte-level pattern alone, it is asked once per distinct piece (with
    the pieces in its own order and of its own cutting); else, and for characters that character
    tables class differently, it encodes the chunk itself.
    """

    def __init__(self, definition: str):
        self.library = tokenizers.Tokenizer.from_str(definition)
        self.library.no_padding()
        self.library.no_truncation()
        parts = json.loads(definition)
        splitter = parts.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in parts.get("added_tokens", [])]
        self.by_pieces = (
            splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
            and not parts.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in parts.get("added_tokens", []))
        )
        self.find = regex.compile(BYTE_LEVEL).findall
        self.sizes: dict[str, int] = {}
        # Where the pattern or a special string could hold a blank there are no proven boundaries.
        self.chunks = self.by_pieces and not any(re.search(r"\s", t) for t in self.special)

    def _pieces(self, texts: list[str]) -> list[list[str] | None]:
        """The pieces of every text that may be cut here, with the sizes of all of them known after."""
        cut = []
        for t in texts:
            if not self.by_pieces or (not t.isascii() and SETTLED.search(t)):
                cut.append(None)
                continue
            # A special string wins over whatever the pattern would take it into, so texts are cut at it first.
            at_special = [t] if not any(s in t for s in self.special) else re.split("(" + "|".join(map(re.escape, self.special)) + ")", t)
            cut.append([p for part in at_special for p in ([part] if part in self.special else self.find(part))])
        wanted = set().union(*(c for c in cut if c))
        new = [p for p in wanted if p not in self.sizes]
        if len(self.sizes) + len(new) > MEMORY:
            self.sizes.clear()
            new = list(wanted)
        for piece, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            self.sizes[piece] = len(e)
        return cut

    def counts(self, texts: list[str]) -> list[int]:
        size = self.sizes.__getitem__
        return [
            len(self.library.encode(t, add_special_tokens=False)) if c is None else sum(map(size, c))
            for t, c in zip(texts, self._pieces(texts))
        ]

    def ends(self, text: str) -> tuple[list[int], list[int]]:
        """Offsets, ascending, at which a token ends, and how many tokens end there or before."""
        (pieces,) = self._pieces([text])
        if pieces is not None:
            return list(accumulate(map(len, pieces))), list(accumulate(map(self.sizes.__getitem__, pieces)))
        at, n = [], []
        for k, (_, end) in enumerate(self.library.encode(text, add_special_tokens=False).offsets):
            if at and end <= at[-1]:
                n[-1] = k + 1
            else:
                at.append(end)
                n.append(k + 1)
        return at, n


def stable(text: str, at: int) -> bool:
    """Whether a token ends at this position whatever the rest of the text is."""
    before = text[at - 1]
    return text[at] in " \n" and (before.isalnum() and before <= "ɏ" or "!" <= before <= "~")


def count_huge(text: str, encoder: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text by overlapping chunks."""
    total, begin, start = 0, 0, 0
    while True:
        wide = overlap
        while True:
            stop = min(len(text), start + chunk + wide)
            at, n = encoder.ends(text[start:stop])
            known = 0 if begin == start else n[bisect_left(at, begin - start)]
            if stop == len(text):
                return total + (n[-1] if n else 0) - known
            follow = start + chunk
            right, _ = encoder.ends(text[follow : min(len(text), follow + chunk + wide)])
            mine = {p + start for p in at}
            splice = next((p + follow for p in right if p + follow < stop and p + follow in mine and stable(text, p + follow)), None)
            if splice is not None:
                break
            wide *= 2
        total += n[bisect_left(at, splice - start)] - known
        # After a very wide overlap the next chunk may begin at the boundary itself.
        begin, start = splice, follow if splice < follow + chunk else splice


def count_tokens(docs: DataFrame, definition: str, key: str, text: str = "text", keep: list[str | Column] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The kept columns (all, if none are named) and `n_tokens` of every whole text; null counts as empty.

    `definition` is the JSON of a tokenizer, `key` names it. Texts of more than a chunk go through
    `count_huge`. Rows are independent, so repeated ones repeat. An input column `n_tokens` is replaced.
    """
    keep = [c for c in docs.columns if c != "n_tokens"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a vocabulary, fixed in size

    def make():
        store = worker_store("tokens")
        if key not in store:
            store[key] = Encoder(shared.value)
        encoder = store[key]

        def run(column):
            texts = [t or "" for t in column.to_pylist()]
            short = [t for t in texts if len(t) <= chunk or not encoder.chunks]
            of_short = iter(encoder.counts(short))
            return [pa.array([next(of_short) if len(t) <= chunk or not encoder.chunks else count_huge(t, encoder, chunk, overlap) for t in texts], pa.int64())]

        return run

    return derive(docs, [F.col(text)], [F.col(c) if isinstance(c, str) else c for c in keep], "n_tokens bigint", make)


def report(docs: DataFrame, definition: str, key: str, limit: int = 512) -> DataFrame:
    """Per document: bytes, tokens, and whether the tokens exceed the limit."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    return count_tokens(docs, definition, key, keep=["doc_id", size]).withColumn("over_limit", F.col("n_tokens") > limit)
