"""URL rules as globs, matched all at once by a bit-parallel automaton.

Every rule is a chain of states: a start, and one per character. All chains lie side by side in rows
of 64-bit words. One step of the Shift-And recurrence, a shift with carry and two masks of the
character read, moves every rule of every URL of a batch one character on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import derive, utf8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A glob over `.host/path`: `**` is any run, `*` any run without a slash, `?` one character but a slash.

    Of the named rules that match, the longest name decides (then the first); rules without a
    name decide where no named one does, block before allow.
    """

    glob: str
    verdict: str
    name: str | None = None


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and paths that begin so."""
    return Rule(f"*.{host}{path}**", verdict, host + path)


class Automaton:
    """Masks of the packed rules."""

    def __init__(self, globs: list[str]):
        chains = [self._chain(g) for g in globs]
        bits = sum(len(states) for states in chains)
        self.words = max(1, -(-bits // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.step = np.zeros((256, self.words), np.uint64)  # states that reading a byte leads into
        self.stay = np.zeros((256, self.words), np.uint64)  # states that a byte leaves as they are
        self.final = []
        at = 0
        for states in chains:
            for k, (reads, loops) in enumerate(states):
                word, bit = at >> 6, np.uint64(1 << (at & 63))
                if k == 0:
                    self.start[word] |= bit
                for byte in range(256):
                    if k and reads(byte):
                        self.step[byte, word] |= bit
                    if loops(byte):
                        self.stay[byte, word] |= bit
                at += 1
            self.final.append((at - 1 >> 6, np.uint64(1 << (at - 1 & 63))))

    @staticmethod
    def _chain(glob: str):
        """Per state: which bytes lead into it, and which leave it as it is."""
        never, always, inside = (lambda b: False), (lambda b: True), (lambda b: b != 0x2F)
        states, data, i = [[never, never]], glob.encode(), 0
        while i < len(data):
            if data[i : i + 2] == b"**":
                states[-1][1] = always
                i += 2
                continue
            if data[i : i + 1] == b"*":
                if states[-1][1] is not always:
                    states[-1][1] = inside
            elif data[i : i + 1] == b"?":
                # One character: its first byte, and those that continue it.
                states.append([lambda b: b != 0x2F and not 0x80 <= b < 0xC0, lambda b: 0x80 <= b < 0xC0])
            else:
                states.append([lambda b, c=data[i]: b == c, never])
            i += 1
        return states

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows by rules: which rule matches the whole of which row."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], offsets[:-1][order]
        state = np.repeat(self.start[None, :], len(size), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(size)
        for j in range(int(size[0]) if len(size) else 0):
            while live and size[live - 1] <= j:
                live -= 1
            byte = data[begin[:live] + j]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.zeros((len(size), len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] & bit) != 0
        return out


def host_of(url: Column) -> Column:
    """From the first `://` up to a slash, a question mark, a hash or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", keep: list[str] | None = None, otherwise: str = "allow") -> DataFrame:
    """The kept columns (all, if none are named) with `host`, `path`, `rule` and `verdict` of every row's URL.

    Null URLs and such without `://` have an empty host and path, which only a rule of nothing but
    wildcards matches. Rows are independent: repeated ones repeat, and a URL of any length is read
    to its end. Input columns of the four names are replaced.
    """
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in urls.columns if c not in new] if keep is None else keep
    named = sorted((r for r in rules if r.name is not None), key=lambda r: -len(r.name))
    rest = [r for v in ("block", "allow") for r in rules if r.name is None and r.verdict == v]
    ordered = [*named, *rest]

    def make():
        automaton = Automaton([r.glob for r in ordered])
        names = pa.array([*[r.name for r in ordered], None], pa.string())
        verdicts = pa.array([*[r.verdict for r in ordered], otherwise], pa.string())

        def run(column):
            hit = automaton.matches(*utf8(column))
            none = np.ones((len(hit), 1), bool)
            first = pa.array(np.argmax(np.concatenate((hit, none), axis=1), axis=1))
            return [names.take(first), verdicts.take(first)]

        return run

    host, path = host_of(F.col(url)), path_of(F.col(url))
    text = F.concat(F.lit("."), host, path)
    return derive(urls, [text], [*[F.col(c) for c in keep], host.alias("host"), path.alias("path")], "rule string, verdict string", make)
