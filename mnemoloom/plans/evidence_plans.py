"""Edges checked against source text, and the text of symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from ..session import stored
from ..sources import views as v
from .registry import query

_SITES = """
    sites AS (SELECT e.src, e.dst, s.file AS file, d.file AS target, d.callable, 1000 + e.dst * 10 + e.line AS true_line,
                     CASE WHEN e.line = 7 THEN 9 - (1000 + e.dst * 10 + e.line) ELSE 1000 + e.dst * 10 + e.line END AS line, e.line AS l
              FROM edges e JOIN symbols s ON s.node_id = e.src JOIN symbols d ON d.node_id = e.dst),
    verdicts AS (SELECT *, CASE WHEN l <> 7 THEN CASE WHEN callable THEN 'confirmed' ELSE 'shadowed' END
                                WHEN callable OR file = target THEN 'moved' ELSE 'absent' END AS verdict FROM sites)"""


def _lines(spark, path):
    """Source lines are a stored table in use; here they are written out once per query."""
    return stored(v.source_lines(spark, path))


def _judged(spark, path):
    sites = v.call_sites(spark, path).select("src", "dst", "file", "line")
    return evidence.edge_verdicts(sites, v.code_symbols(spark, path), _lines(spark, path))


@query("symbols edges", f", {_SITES} SELECT src, dst, line, verdict FROM verdicts")
def edge_verdicts(spark, path):
    return _judged(spark, path).select("src", "dst", F.col("line").cast("bigint").alias("line"), "verdict")


@query("symbols edges", f", {_SITES} SELECT dst AS node_id, count(*) AS rejected FROM verdicts WHERE verdict IN ('shadowed', 'absent') GROUP BY 1")
def callers_rejected(spark, path):
    return evidence.rejected(_judged(spark, path))


@query(
    "symbols edges",
    f""", {_SITES}, src_lines AS (
            SELECT file, line, array_to_string(list_sort(list('function part' || node_id || '(a) {{}}')), ' ') AS text FROM symbols GROUP BY file, line
            UNION ALL SELECT DISTINCT file, true_line, CASE WHEN callable THEN '  part' ELSE '  x.part' END || dst || '(y)' FROM sites)
        SELECT node_id, s.line, string_agg(l.text, chr(10) ORDER BY l.line) AS text
        FROM symbols s JOIN src_lines l ON l.file = s.file AND l.line BETWEEN s.line AND s.line + 13 GROUP BY node_id, s.line""",
)
def symbol_slices(spark, path):
    return evidence.slices(v.code_symbols(spark, path), _lines(spark, path)).select("node_id", "line", "text")


@query()
def evidence_packet(spark, path):
    """Source and verified neighbours of the symbols each brand's code is most called through."""
    symbols, lines = v.code_symbols(spark, path), _lines(spark, path)
    sites = v.call_sites(spark, path).select("src", "dst", "file", "line")
    good = stored(evidence.verified_edges(evidence.edge_verdicts(sites, symbols, lines)))
    return evidence.packet(symbols.select("node_id"), symbols, good, lines).select(
        "node_id", "header", "chars"
    )
