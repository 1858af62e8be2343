"""Which symbol owns a line: spans, and their joins with points and with line ranges.

Spans of a file do not overlap, so cutting spans and ranges into blocks of lines
turns the interval joins into equi-joins on (file, block) whose groups are at most
a block wide. A busy file is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordering import next_in_group

BLOCK = 64
# Stands for "to the end of the file" in an integer column.
OPEN_END = 2_147_483_647


def _slashes(file: str) -> Column:
    return F.translate(F.col(file), "\\", "/")


def symbol_spans(symbols: DataFrame) -> DataFrame:
    """(node_id, file, from_line, to_line): from a definition to just before the next one.

    Files, and symbols without a line, own nothing. Of several symbols on one line
    the last by id owns what follows and the others an empty span. The next line is
    looked up over distinct lines, which the partial aggregation reduces first.
    """
    real = symbols.filter(
        F.col("line").isNotNull() & (F.coalesce("file", F.lit("")) != "") & ~tx.is_file_node("name", "file")
    ).select("node_id", _slashes("file").alias("file"), F.col("line").alias("from_line"))
    lines = real.groupBy("file", "from_line").agg(F.max("node_id").alias("_owner"))
    follow = next_in_group(lines, "file", "from_line", "_next")
    end = F.when(F.col("node_id") == F.col("_owner"), F.coalesce(F.col("_next") - 1, F.lit(OPEN_END)))
    return real.join(follow, ["file", "from_line"]).select(
        "node_id", "file", "from_line", end.otherwise(F.col("from_line") - 1).cast("int").alias("to_line")
    )


def _block_list(lo: Column, hi: Column) -> Column:
    first, last = F.floor(lo / F.lit(BLOCK)), F.floor(hi / F.lit(BLOCK))
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _blocks(lo: Column, hi: Column) -> Column:
    return F.explode(_block_list(lo, hi))


def _owned(spans: DataFrame, reach: DataFrame) -> DataFrame:
    """Spans cut into blocks; an open end stops at the last line anything asks about."""
    bounded = spans.join(reach, "file").filter(F.col("from_line") <= F.col("_max"))
    # An empty span lies between two lines and belongs to the blocks of both.
    first, last = F.least("from_line", "to_line"), F.greatest(F.col("from_line"), F.least("to_line", "_max"))
    return bounded.select("node_id", "file", "from_line", "to_line", _blocks(first, last).alias("_block"))


def enclosing(points: DataFrame, spans: DataFrame, line: str = "line") -> DataFrame:
    """Each (file, line) point with the `node_id` whose span holds it; points nothing owns keep null."""
    reach = points.groupBy("file").agg(F.max(line).alias("_max"))
    owned = _owned(spans, reach).withColumnRenamed("file", "_file")
    at = points.withColumn("_b", F.floor(F.col(line) / F.lit(BLOCK)))
    inside = (
        (F.col("file") == F.col("_file"))
        & (F.col("_b") == F.col("_block"))
        & F.col(line).between(F.col("from_line"), F.col("to_line"))
    )
    return at.join(owned, inside, "left").select(*points.columns, "node_id")


def _lines(lo: Column, hi: Column) -> Column:
    """The lines lo..hi that lie in block `_block`, as the bits of a number; lo <= hi, and the block holds one of them."""
    base = F.col("_block") * BLOCK
    first, last = F.greatest(lo, base) - base, F.least(hi, base + (BLOCK - 1)) - base
    ones = F.lit(-1).cast("bigint")
    return F.call_function("shiftleft", ones, first.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", ones, (BLOCK - 1 - last).cast("int")))


def line_masks(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, file, _block, _lo, _hi, _lines, _joints): the lines of each block that changed ranges (file, lo, hi) cover, as bits.

    A bit of `_joints` stands for a line that a range covers together with the line before it. Removals (hi < lo) have no
    lines of their own and keep their ends in `_lo` and `_hi`, null in all others. Ranges without ends keep a row without a block.
    """
    by = by or []
    cut_up = ranges.select(*by, "file", "lo", "hi", F.explode_outer(_block_list(F.least("lo", "hi"), F.greatest("lo", "hi"))).alias("_block"))
    # A range without an end has no block; `least` would take the other end for it.
    block = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.col("_block"))
    whole = F.col("lo") <= F.col("hi")
    pieces = cut_up.withColumn("_block", block).select(
        *by, "file", "lo", "_block",
        F.when(F.col("hi") < F.col("lo"), F.col("lo")).alias("_lo"), F.when(F.col("hi") < F.col("lo"), F.col("hi")).alias("_hi"),
        F.when(whole, _lines(F.col("lo"), F.col("hi"))).alias("_lines"),
    )
    begins = F.col("lo") >= F.col("_block") * BLOCK
    joints = F.when(begins, F.col("_lines").bitwiseAND(F.call_function("shiftleft", F.col("_lines"), F.lit(1)))).otherwise(F.col("_lines"))
    return pieces.withColumn("_joints", joints).groupBy(*by, "file", "_block", "_lo", "_hi").agg(
        F.bit_or("_lines").alias("_lines"), F.bit_or("_joints").alias("_joints")
    )


def met_by(masks: DataFrame, spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, node_id, file) of symbols whose span meets a range of `line_masks`, once per block and kind of range that meets it.

    An empty span lies between two lines and is met by what covers both.
    """
    reach = masks.groupBy("file").agg((F.max("_block") * BLOCK + (BLOCK - 1)).alias("_max"))
    begin, end = F.col("from_line"), F.col("to_line")
    inside = F.floor(begin / F.lit(BLOCK)) == F.col("_block")
    owned = _owned(spans, reach).withColumn(
        "_mask", F.when(begin <= end, _lines(begin, end)).otherwise(F.when(inside, _lines(begin, begin)).otherwise(F.lit(0)))
    )
    covered = F.when(begin <= end, F.col("_lines")).otherwise(F.col("_joints"))
    meets = F.when(F.col("_lo").isNotNull(), (F.col("_hi") >= begin) & (F.col("_lo") <= end)).otherwise(covered.bitwiseAND(F.col("_mask")) != 0)
    return masks.join(owned, ["file", "_block"]).filter(meets).select(*(by or []), "node_id", "file")


def in_ranges(ranges: DataFrame, spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct (*by, node_id, file) of symbols whose span meets a changed range (file, lo, hi).

    A range is first reduced to the lines it covers inside each block, so the join meets at most a block of lines per file
    and block. A removal (hi = lo - 1) has no line of its own and meets the span around it.
    """
    return met_by(line_masks(ranges, by), spans, by).distinct()
