"""Connected components of a graph of links, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored


def components(links: DataFrame) -> DataFrame:
    """`node` and `component`, the smallest node it is connected with, for every end (`a`, `b`) of a link.

    Stars are contracted in turn: every node hands its larger neighbours to its smallest one, then
    does so with its smaller ones. The number of rounds grows with the logarithm of the longest
    chain. Rounds are written to the shared folder; nothing is gathered but whether all are stars.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = stored(edges)
    while not _stars(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
        large = edges.join(least, "lo").select("hi", F.col("m").alias("lo"))
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small, "hi")
        before, edges = edges, stored(joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").union(small.toDF("hi", "lo")).distinct())
        discard(before)
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.toDF("node", "component").union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones: then its component is known, and no round would move it."""
    ends = edges.select(F.col("hi").alias("u"), F.col("lo").alias("m")).union(edges.select("lo", F.lit(None).cast(edges.schema["lo"].dataType)))
    told = ends.groupBy("u").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.count_if(F.col("m").isNull()).alias("larger"))
    return told.filter("low <> high or (low is not null and larger > 0)").isEmpty()
