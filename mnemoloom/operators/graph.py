"""The code graph as two tables: symbols (node_id, name, file, line, ...) and edges (src, dst, ...).

An edge read forward is a call, read backward a caller. Nothing is turned into
adjacency lists, so a hub is rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def valid_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = symbols.select("node_id")
    return edges.join(ids, edges["src"] == ids["node_id"], "left_semi").join(
        ids, F.col("dst") == F.col("node_id"), "left_semi"
    )


def degree(edges: DataFrame) -> DataFrame:
    """(node_id, degree): edges in and out, repeats counted, a self-loop twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, calls_in, calls_out, degree)."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.node_id").alias("node_id")).agg(
        F.sum("e.i").alias("calls_in"), F.sum("e.o").alias("calls_out"), F.count(F.lit(1)).alias("degree")
    )


def neighbours(edges: DataFrame, symbols: DataFrame, ids: DataFrame, direction: str) -> DataFrame:
    """(of, node_id, name, file, line): distinct callers or callees of the given `node_id`s."""
    near, far = ("dst", "src") if direction == "callers" else ("src", "dst")
    of = ids.select(F.col("node_id").alias("of"))
    pairs = edges.join(of, edges[near] == of["of"]).select("of", F.col(far).alias("node_id")).distinct()
    return pairs.join(symbols.select("node_id", "name", "file", "line"), "node_id").select(
        "of", "node_id", "name", "file", "line"
    )


def callers_of(edges, symbols, ids):
    return neighbours(edges, symbols, ids, "callers")


def callees_of(edges, symbols, ids):
    return neighbours(edges, symbols, ids, "callees")


def hubs(edges: DataFrame, symbols: DataFrame, limit: int = 20) -> DataFrame:
    """The most connected callable symbols; files are not symbols here."""
    real = symbols.filter(F.col("callable") & ~tx.is_file_node("name", "file"))
    return (
        real.join(degrees(edges), "node_id")
        .orderBy(F.col("degree").desc(), "node_id")
        .limit(limit)
        .select("node_id", "name", "file", "degree", "calls_in", "calls_out")
    )
