"""Change history and colliding work streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collide, history
from ..session import stored
from ..sources import views as v
from .graph_plans import _SPANS, _graph
from .registry import query


@query("commit_files", """SELECT file, count(DISTINCT "commit") AS commits, count(DISTINCT author) AS authors, max("at") AS last
                          FROM commit_files GROUP BY file""")
def churn_by_file(spark, path):
    return history.churn(v.commit_files(spark, path))


_PAIRS = """
    small AS (SELECT "commit" FROM commit_files GROUP BY "commit" HAVING count(*) <= 8),
    pairs AS (SELECT x.file AS a, y.file AS b, count(*) AS together FROM commit_files x JOIN commit_files y
              ON x."commit" = y."commit" AND x.file < y.file WHERE x."commit" IN (FROM small) GROUP BY ALL)"""


@query("commit_files", f", {_PAIRS} SELECT a, b, together FROM pairs")
def cochange_pairs(spark, path):
    return history.cochange(v.commit_files(spark, path), max_files=8)


@query(
    "commit_files",
    f""", {_PAIRS} SELECT a, b, together FROM pairs WHERE together >= 3
        AND regexp_replace(a, '/[^/]*$', '') <> regexp_replace(b, '/[^/]*$', '') ORDER BY together DESC, a, b LIMIT 8""",
)
def coupling_topk(spark, path):
    return history.coupling(history.cochange(v.commit_files(spark, path), max_files=8))


_FILE_EDGES = """
    file_edges AS (SELECT DISTINCT s.file AS from_file, d.file AS to_file FROM edges
                   JOIN symbols s ON s.node_id = src JOIN symbols d ON d.node_id = dst),
    fans AS (SELECT to_file AS file, count(*) AS fan FROM file_edges WHERE from_file <> to_file GROUP BY 1),
    tested AS (SELECT DISTINCT to_file AS file FROM file_edges WHERE from_file LIKE '%/tests/%' AND to_file NOT LIKE '%/tests/%')"""


@query("symbols edges", f", {_FILE_EDGES} SELECT * FROM fans")
def fan_in(spark, path):
    symbols, edges = _graph(spark, path)
    return history.fan_in(edges, symbols)


@query("symbols edges", f", {_FILE_EDGES} SELECT * FROM tested")
def tested_files(spark, path):
    symbols, edges = _graph(spark, path)
    return history.tested_files(edges, symbols)


_NOW = 1_000_000_000
_RISK = f"""
    {_FILE_EDGES},
    churn AS (SELECT file, count(DISTINCT "commit") AS commits, count(DISTINCT author) AS authors, max("at") AS last,
                     min(author) AS author FROM commit_files GROUP BY file),
    m AS (SELECT greatest(max(commits), 1) AS mc, (SELECT greatest(coalesce(max(fan), 1), 1) FROM fans) AS mf,
                 (SELECT count(DISTINCT author) <= 1 FROM commit_files) AS solo FROM churn),
    ranked AS (
        SELECT c.file, commits, authors, coalesce(fan, 0) AS fan, t.file IS NOT NULL AS tested,
               (commits / mc + 0.15) * (coalesce(fan, 0) / mf + 0.15) AS risk,
               concat_ws('; ', CASE WHEN commits >= greatest(3, mc * 0.5) THEN commits || ' commits' END,
                         CASE WHEN coalesce(fan, 0) >= greatest(2, mf * 0.5) THEN fan || ' dependent file(s)' END,
                         CASE WHEN t.file IS NULL THEN 'no test reaches it' END,
                         CASE WHEN authors = 1 AND NOT solo THEN 'one author (' || author || ')' END) AS why,
               CAST(floor(({_NOW} - last) / 86400) AS BIGINT) AS last_days
        FROM churn c LEFT JOIN fans USING (file) LEFT JOIN tested t ON t.file = c.file, m
        WHERE c.file NOT LIKE '%/tests/%' AND c.file IN (SELECT file FROM symbols))"""


def _ranked(spark, path):
    symbols, edges = _graph(spark, path)
    ranked = history.risk(v.commit_files(spark, path), edges, symbols, now=_NOW)
    return ranked.withColumn("risk", F.round("risk", 9)).withColumn("why", F.array_join("why", "; "))


@query("commit_files symbols edges", f", {_RISK} SELECT * REPLACE (round(risk, 9) AS risk) FROM ranked")
def risk_all(spark, path):
    return _ranked(spark, path)


@query(
    "commit_files symbols edges",
    f""", {_RISK} SELECT * REPLACE (round(risk, 9) AS risk) FROM ranked ORDER BY round(risk, 9) DESC, commits DESC, file LIMIT 12""",
)
def risk_rank(spark, path):
    return history.riskiest(_ranked(spark, path))


@query(
    "commit_files symbols edges",
    f""", {_RISK} SELECT file, commits FROM ranked WHERE tested AND commits >= 2
        ORDER BY round(risk, 9), commits, file DESC LIMIT 3""",
)
def safest_files(spark, path):
    return history.safest(_ranked(spark, path)).select("file", "commits")


# Streams --------------------------------------------------------------------
_CHANGES = f"""
    {_SPANS},
    changed_files AS (SELECT DISTINCT stream, file FROM ranges),
    changes AS (SELECT DISTINCT stream, node_id, s.file FROM ranges r JOIN spans s
                ON r.file = s.file AND r.hi >= s.from_line AND r.lo <= s.to_line)"""
_NEEDS = """
    needs AS (SELECT x.stream AS name, y.stream AS needs, count(DISTINCT dst) AS callees
              FROM changes x JOIN edges ON x.node_id = src JOIN changes y ON y.node_id = dst AND x.stream <> y.stream
              GROUP BY ALL)"""


def _streams(spark, path):
    return collide.Streams.of_masks(collide.stream_masks(v.ranges(spark, path)), v.symbols(spark, path))


@query(
    "ranges symbols",
    f""", {_CHANGES} SELECT stream, count(DISTINCT file) AS files,
            (SELECT count(*) FROM changes c WHERE c.stream = f.stream) AS symbols FROM changed_files f GROUP BY stream""",
)
def stream_change_counts(spark, path):
    files, changes = collide.stream_changes(v.ranges(spark, path), v.symbols(spark, path))
    per_stream = changes.groupBy("stream").agg(F.count(F.lit(1)).alias("symbols"))
    out = files.groupBy("stream").agg(F.count(F.lit(1)).alias("files")).join(per_stream, "stream", "left")
    return out.fillna(0, ["symbols"])


_SHARED = """
    ss AS (SELECT x.stream AS a, y.stream AS b, count(*) AS n, list(DISTINCT x.file) AS fought
           FROM changes x JOIN changes y ON x.node_id = y.node_id AND x.stream < y.stream GROUP BY ALL),
    sf AS (SELECT x.stream AS a, y.stream AS b, count(*) AS n
           FROM changed_files x JOIN changed_files y ON x.file = y.file AND x.stream < y.stream GROUP BY ALL),
    shared AS (SELECT a, b, coalesce(ss.n, 0) AS shared_symbols, coalesce(sf.n, 0) - coalesce(len(fought), 0) AS shared_files
               FROM ss FULL JOIN sf USING (a, b))"""


@query("ranges symbols", f", {_CHANGES}, {_SHARED} SELECT * FROM shared")
def stream_pairs(spark, path):
    return _streams(spark, path).shared()


@query("ranges symbols edges", f", {_CHANGES}, {_NEEDS} SELECT * FROM needs")
def stream_dependencies(spark, path):
    return _streams(spark, path).dependencies(v.links(spark, path))


# Depth is that of the longest chain below; a chain longer than there are streams goes round in a circle.
_ORDER = """
    before AS (SELECT x.name, x.needs FROM needs x LEFT JOIN needs y ON y.name = x.needs AND y.needs = x.name
               WHERE row(x.callees, x.name) > row(coalesce(y.callees, 0), x.needs)),
    names AS (SELECT DISTINCT stream AS name FROM changed_files), many AS (SELECT count(*) + 1 AS n FROM names),
    chain(name, d) AS (SELECT name, 0 FROM names UNION SELECT b.name, d + 1 FROM chain c JOIN before b ON b.needs = c.name, many WHERE d < n)
    SELECT name, CASE WHEN max(d) < n THEN CAST(max(d) AS INTEGER) END AS layer FROM chain, many GROUP BY name, n"""


@query("ranges symbols edges", f"RECURSIVE , {_CHANGES}, {_NEEDS}, {_ORDER}")
def merge_order(spark, path):
    """Landing order where, of two streams needing each other, the one needing more comes later."""
    masks = collide.stream_masks(v.ranges(spark, path))
    needs = stored(collide.Streams.of_masks(masks, v.symbols(spark, path)).dependencies(v.links(spark, path)))
    other = needs.select(F.col("needs").alias("name"), F.col("name").alias("needs"), F.col("callees").alias("back"))
    more = F.struct("callees", "name") > F.struct(F.coalesce("back", F.lit(0)).alias("callees"), F.col("needs").alias("name"))
    before = needs.join(other, ["name", "needs"], "left").filter(more).select("name", "needs")
    return collide.merge_order(masks.select(F.col("stream").alias("name")).distinct(), before)


@query(
    "ranges symbols edges",
    f""", {_CHANGES}, {_NEEDS}, {_SHARED},
        pairs AS (SELECT a, b, shared_symbols, shared_files, 0 AS x, 0 AS y FROM shared
                  UNION ALL SELECT least(name, needs), greatest(name, needs), 0, 0, CASE WHEN name < needs THEN callees ELSE 0 END,
                                   CASE WHEN name > needs THEN callees ELSE 0 END FROM needs)
        SELECT a, b, CAST(sum(shared_symbols) AS BIGINT) AS shared_symbols, CAST(sum(shared_files) AS BIGINT) AS shared_files,
               CAST(sum(x) AS BIGINT) AS a_needs_b, CAST(sum(y) AS BIGINT) AS b_needs_a
        FROM pairs GROUP BY a, b HAVING sum(shared_symbols) + sum(shared_files) + sum(x) + sum(y) > 0""",
)
def stream_compare(spark, path):
    """Every pair of streams with shared code and needs either way."""
    return _streams(spark, path).compare(v.links(spark, path))
