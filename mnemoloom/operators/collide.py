"""Work streams against each other: what they both change, and who has to land first.

`changes` is (stream, file, node_id): the symbols each stream touched; `files` is
(stream, file). Streams are few (the branches in flight), so their pairs are the
answer and not an intermediate; symbols and files may be many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordering import dense_index
from .spans import line_masks, met_by, symbol_spans
from .traversal import merge_order as _layers

# Streams of a set that share a number, as its bits.
_WORD = 64


def stream_masks(ranges: DataFrame) -> DataFrame:
    """The lines every stream changed, from its changed ranges (stream, file, lo, hi); written out once, as all below reads them."""
    return stored(line_masks(ranges, ["stream"]))


def stream_changes(ranges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) per stream from its changed ranges (stream, file, lo, hi)."""
    masks = stream_masks(ranges)
    return masks.select("stream", "file").distinct(), met_by(masks, symbol_spans(symbols), ["stream"]).distinct()


def _members(word: str = "_word", bits: str = "_bits") -> str:
    """The numbers in one word of a set."""
    return f"transform(filter(sequence(0, {_WORD - 1}), i -> getbit({bits}, i) = 1), i -> {word} * {_WORD} + i)"


def _packed(rows: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """(*keys, _word, _bits): the set of streams of every key, as the bits of numbers; sets are joined by `bit_or`, without sorting."""
    # As many names as there are streams.
    numbered = rows.join(F.broadcast(names), "stream").select(*keys, F.expr(f"_no div {_WORD}").cast("int").alias("_word"), F.expr(f"shiftleft(1L, CAST(_no % {_WORD} AS INT))").alias("_bits"))
    return _merged(numbered, *keys)


def _merged(words: DataFrame, *keys: str) -> DataFrame:
    return words.groupBy(*keys, "_word").agg(F.bit_or("_bits").alias("_bits"))


def _sets(words: DataFrame, *keys: str) -> DataFrame:
    """(*keys, _set): all words of a key's set in one row."""
    return words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("_set"))


def _listed(set_: str) -> str:
    """The numbers of a whole set, ascending."""
    return f"flatten(transform({set_}, w -> {_members('w._word', 'w._bits')}))"


def _spelled(sets: DataFrame, out: str) -> DataFrame:
    """(a, b, out): in how many rows every two streams a < b stand together. Equal sets are counted before their pairs are spelled out."""
    counted = sets.groupBy("_set").agg(F.count(F.lit(1)).alias("_n")).select("_n", F.expr(_listed("_set")).alias("_all"))
    pairs = counted.select("_n", "_all", F.explode("_all").alias("a")).select("_n", "a", F.explode("_all").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.sum("_n").alias(out))


def _against(rows: DataFrame, out: str) -> DataFrame:
    """(a, b, out): in how many rows (a, _word, _bits) every stream `a` stands against the set's `b`. Equal rows are counted first."""
    counted = rows.groupBy("a", "_word", "_bits").agg(F.count(F.lit(1)).alias("_n"))
    return counted.select("_n", "a", F.explode(F.expr(_members())).alias("b")).groupBy("a", "b").agg(F.sum("_n").alias(out))


def _added(tables: list[DataFrame], *columns: str) -> DataFrame:
    """(a, b, *columns): columns summed over tables that have some of them, 0 where none has."""
    whole = [t.select("a", "b", *[F.col(c) if c in t.columns else F.lit(0).cast("bigint").alias(c) for c in columns]) for t in tables]
    rows = whole[0]
    for t in whole[1:]:
        rows = rows.unionAll(t)
    return rows.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in columns])


@dataclass(frozen=True)
class Streams:
    """What streams touch: `names` (stream, _no) in the order of names, sets of numbers per file and per symbol (`_packed`)."""

    names: DataFrame
    files: DataFrame
    symbols: DataFrame

    @staticmethod
    def of(files: DataFrame, changes: DataFrame) -> Streams:
        """From plain rows (stream, file) and (stream, node_id, file)."""
        names = _numbers(files.select("stream").unionAll(changes.select("stream")))
        return Streams(names, _packed(files, names, "file"), stored(_packed(changes, names, "node_id", "file")))

    @staticmethod
    def of_masks(masks: DataFrame, symbols: DataFrame) -> Streams:
        """From the lines that `stream_masks` gives."""
        names = _numbers(masks)
        met = met_by(masks, symbol_spans(symbols), ["stream"])
        return Streams(names, _packed(masks, names, "file"), stored(_packed(met, names, "node_id", "file")))

    def _named(self, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        for c, out in (("a", a), ("b", b)):
            names = F.broadcast(self.names.select(F.col("_no").alias(c), F.col("stream").alias(f"_{c}")))
            pairs = pairs.join(names, c).drop(c)
        return pairs.select(F.col("_a").alias(a), F.col("_b").alias(b), *[c for c in pairs.columns if c not in ("_a", "_b")])

    def _shared(self) -> DataFrame:
        symbols = _spelled(_sets(self.symbols, "node_id", "file"), "shared_symbols")
        # Of every file the streams that share a symbol of it with a stream `a`: the sets of symbols that hold `a`, joined into one.
        by_file = _sets(self.symbols.repartition("file"), "node_id", "file")
        near = by_file.select("file", "_set", F.explode(F.expr(_listed("_set"))).alias("a")).select("file", "a", F.explode("_set").alias("_w"))
        fought = _against(_merged(near.select("file", "a", "_w._word", "_w._bits"), "file", "a"), "_n").filter("a < b")
        files = _spelled(_sets(self.files.filter("file IS NOT NULL"), "file"), "shared_files")
        return _added([symbols, files, fought.select("a", "b", (-F.col("_n")).alias("shared_files"))], "shared_symbols", "shared_files")

    def shared(self) -> DataFrame:
        """(a, b, shared_symbols, shared_files) of every two streams that meet, a < b.

        A shared file counts only where the two share none of its symbols. Every symbol and file becomes its set of streams, so
        no table meets itself.
        """
        return self._named(self._shared())

    def _needs(self, edges: DataFrame) -> DataFrame:
        """(a, b, callees): of the symbols called, those whose callers `a` changed and that `b` changed."""
        touched = _merged(self.symbols, "node_id")
        called = touched.withColumnRenamed("node_id", "dst")
        # Ends that no stream touched, or that do not exist, count for nothing.
        calls = edges.select("src", "dst").join(called.select("dst"), "dst", "left_semi")
        callers = _merged(calls.join(touched.withColumnRenamed("node_id", "src"), "src"), "dst")
        met = callers.select("dst", F.explode(F.expr(_members())).alias("a")).join(called, "dst")
        return _against(met, "callees").filter("a <> b")

    def dependencies(self, edges: DataFrame) -> DataFrame:
        """(name, needs, callees): streams whose changed code calls symbols another stream changed."""
        return self._named(self._needs(edges), "name", "needs")

    def compare(self, edges: DataFrame) -> DataFrame:
        """One row per pair of streams with anything between them: shared code and needs either way."""
        needs = self._needs(edges)
        ways = needs.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            F.when(F.col("a") < F.col("b"), F.col("callees")).otherwise(0).alias("a_needs_b"),
            F.when(F.col("a") > F.col("b"), F.col("callees")).otherwise(0).alias("b_needs_a"),
        )
        out = _added([self._shared(), ways], "shared_symbols", "shared_files", "a_needs_b", "b_needs_a")
        return self._named(out.filter("shared_symbols > 0 OR shared_files > 0 OR a_needs_b > 0 OR b_needs_a > 0"))


def _numbers(rows: DataFrame) -> DataFrame:
    """(stream, _no): streams numbered in the order of their names; one without a name meets no other."""
    return dense_index(rows.filter("stream IS NOT NULL").select("stream").distinct(), "stream", "_no")


def shared(files: DataFrame, changes: DataFrame) -> DataFrame:
    return Streams.of(files, changes).shared()


def dependencies(changes: DataFrame, edges: DataFrame) -> DataFrame:
    return Streams.of(changes.select("stream", "file"), changes).dependencies(edges)


def compare(files: DataFrame, changes: DataFrame, edges: DataFrame) -> DataFrame:
    return Streams.of(files, changes).compare(edges)


def merge_order(names: DataFrame, needs: DataFrame) -> DataFrame:
    """(name, layer): what can land first; no layer means entangled with a cycle."""
    return _layers(names, needs)
