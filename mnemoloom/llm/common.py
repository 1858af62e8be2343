"""What the operators share: sessions, columns computed by Arrow batches, and texts as byte arrays."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import tune

# Rows of one Arrow batch, so that a worker holds a bounded number of texts.
BATCH_ROWS = "500"
# Bytes of text that a function over a batch sees at a time: what it makes of them may be fifty times as large.
SLICE_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """The library's session settings, and small batches for texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def derive(df: DataFrame, inputs: list[Column | int], keep: list[Column], out: str, make: Callable[[], Callable]) -> DataFrame:
    """The columns of `keep`, then those that a function computes from `inputs`, batch by batch and without a shuffle.

    `make` runs once per task and gives the function: Arrow arrays in, a list of Arrow arrays of
    equal length out. An input that is kept as well is given by its place in `keep` and travels once. The function sees
    slices of a bounded number of bytes of the first text among its inputs. Columns travel by position, so their
    names may clash with anything.
    """
    kept = df.select(*keep)
    added = T.StructType.fromDDL(out)
    schema = T.StructType([*kept.schema.fields, *added.fields])
    n = len(keep)
    new = [c for c in inputs if not isinstance(c, int)]
    later = iter(range(n, n + len(new)))
    places = [c if isinstance(c, int) else next(later) for c in inputs]
    source = df.select(*[c.alias(f"c{i}") for i, c in enumerate([*keep, *new])])
    texts = [k for k in places if isinstance(source.schema[k].dataType, (T.StringType, T.BinaryType))]

    def run(batches):
        fn = make()
        for batch in batches:
            for b in slices(batch, texts[0], SLICE_BYTES) if texts else [batch]:
                columns = list(b.columns)
                yield pa.RecordBatch.from_arrays([*columns[:n], *fn(*[columns[k] for k in places])], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, size: int):
    """A batch in pieces of whole rows with about so many bytes in a column of texts; a longer text is a piece of its own."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(int(np.searchsorted(ends, before + size, side="right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by the tasks it runs one after another.

    Only for memory of pure functions: nothing depends on what is or is not in it.
    """
    holder = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store"))
    return holder.__dict__.setdefault(name, {})


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row's first byte, with one more for the end. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, np.int32)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of every run of word bytes; `is_word` is a table of 256 flags."""
    inside = is_word[data]
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def crc32_text(column: Column) -> Column:
    return F.crc32(column.cast("string"))
