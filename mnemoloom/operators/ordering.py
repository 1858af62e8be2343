"""Orderings that hold without gathering a group, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First `n` rows of each key.

    Spark prunes each input partition to its own first `n` before the shuffle,
    so a key holding a third of the table ships `n` rows per partition.
    """
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def suffix_within(
    df: DataFrame, key: str, position: str, length: str, budget: int, block: int = 1024
) -> DataFrame:
    """The newest rows of each key whose lengths fit the budget, stopping at the first overflow.

    `position` is an integer that orders the rows of a key. The running total is
    taken in two steps: totals per block of positions first, so only the blocks
    that can still hold a surviving row are totalled row by row.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)))
    newest_first = W.partitionBy(key).orderBy(F.col("_block").desc())
    blocks = (
        blocked.groupBy(key, "_block")
        .agg(F.sum(length).alias("_sum"))
        .withColumn("_before", F.sum("_sum").over(newest_first) - F.col("_sum"))
        .filter(F.col("_before") <= budget)
        .select(key, "_block", "_before")
    )
    within = W.partitionBy(key, "_block").orderBy(F.col(position).desc())
    return (
        blocked.join(blocks, [key, "_block"])
        .withColumn("_total", F.col("_before") + F.sum(length).over(within))
        .filter(F.col("_total") <= budget)
        .drop("_block", "_before", "_total")
    )


def next_in_group(df: DataFrame, key: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """`df` must be distinct on (key, value); adds the next larger value of the key, or null.

    Values are looked at in blocks; a block's last value takes the first value of
    the next block that has one. No task ever holds more than a block of a key.
    """
    blocked = df.withColumn("_block", F.floor(F.col(value) / F.lit(block)))
    firsts = blocked.groupBy(key, "_block").agg(F.min(value).alias("_first"))
    follow = firsts.select(
        key, "_block", F.lead("_first").over(W.partitionBy(key).orderBy("_block")).alias("_following")
    )
    inside = F.lead(value).over(W.partitionBy(key, "_block").orderBy(value))
    return (
        blocked.withColumn("_inside", inside)
        .join(follow, [key, "_block"])
        .withColumn(out, F.coalesce("_inside", "_following"))
        .drop("_inside", "_following", "_block")
    )


def dense_index(df: DataFrame, order: str | list[Column], out: str) -> DataFrame:
    """Number rows 1, 2, 3... in `order`, over range partitions instead of one global window.

    The range shuffle is materialised once, because its partition sizes and its
    rows have to come from the same split.
    """
    by = [F.col(order)] if isinstance(order, str) else order
    ranged = stored(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    # One row per partition of the range shuffle: bounded by the partition count.
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*by))
    return (
        ranged.withColumn("_row", inside)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )
