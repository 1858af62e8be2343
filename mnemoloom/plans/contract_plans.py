"""Routes, calls, and the map of services they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contracts
from ..sources import views as v
from .registry import query


@query("", f"SELECT page_id, {v.sql_normalise_path('url')} AS path FROM pages")
def route_normalise(spark, path):
    return v.table(spark, path, "pages").select("page_id", tx.normalise_path("url").alias("path"))


@query(
    "",
    f"""SELECT side, service, file, line, method, path, base_name, via_wrapper FROM (
          SELECT CASE WHEN serves THEN 'provides' ELSE 'consumes' END AS side,
                 regexp_extract(host, '([a-z0-9-]+\\.[a-z]+)$', 1) AS service, host || '/p' || page_id || '.js' AS file,
                 CASE WHEN serves THEN 3 ELSE 2 END AS line, CASE WHEN serves THEN 'POST' END AS method,
                 {v.sql_normalise_path("CASE WHEN serves THEN regexp_replace(raw, '/[0-9]+', '/:id', 'g') ELSE raw END")} AS path,
                 CASE WHEN NOT serves THEN 'billing' END AS base_name, false AS via_wrapper, raw
          FROM (SELECT page_id, url LIKE 'https:%' AS serves, regexp_extract(url, '://([^/]+)', 1) AS host,
                       regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS raw FROM pages))
        WHERE raw NOT LIKE '%.html' AND length(raw) > 1""",
)
def contract_scan(spark, path):
    """Both halves found in the source text written for every page."""
    found = contracts.scan(v.source_files(spark, path))
    return found.select("side", "service", "file", "line", "method", "path", "base_name", "via_wrapper")


# The oracle pairs site by site, as the definition reads.
_MATCH = """
    p AS (SELECT * FROM routes WHERE side = 'provides'), c AS (SELECT * FROM routes WHERE side = 'consumes'),
    cand AS (
        SELECT c.file AS cf, c.line AS cl, c.service AS cs, c.method AS cm, c.dynamic AS cd,
               p.file AS pf, p.line AS pl, p.service AS ps, p.method AS pm, p.dynamic AS pd, p.path AS path, false AS suffix
        FROM c JOIN p ON c.path = p.path
        UNION ALL
        SELECT c.file, c.line, c.service, c.method, c.dynamic, p.file, p.line, p.service, p.method, p.dynamic, p.path, true
        FROM c JOIN p ON ends_with(p.path, c.path) AND p.path <> c.path
        WHERE c.via_wrapper AND c.path NOT IN (SELECT path FROM p)),
    e AS (SELECT * FROM (SELECT *, max(CASE WHEN cm = pm THEN 1 ELSE 0 END) OVER (PARTITION BY cf, cl) AS agreed FROM cand)
          WHERE agreed = 0 OR cm = pm),
    edges AS (SELECT path, coalesce(pm, cm) AS method, cs AS from_service, ps AS to_service, cs <> ps AS cross_service,
                     CASE WHEN suffix THEN 'suffix match' WHEN cm IS NULL THEN 'path only'
                          WHEN cd OR pd THEN 'pattern match' ELSE 'literal match' END AS confidence, cf, cl, pf, pl FROM e)"""
_GROUPED = """SELECT path, method, from_service, to_service, cross_service, confidence, count(*) AS edges FROM edges"""


def _edges(spark, path):
    sites = v.routes(spark, path)
    return sites, contracts.match(sites)


def _summed(edges):
    keys = ["path", "method", "from_service", "to_service", "cross_service", "confidence"]
    return edges.groupBy(*keys).agg(F.sum("edges").alias("edges"))


@query("routes", f", {_MATCH} {_GROUPED} GROUP BY ALL")
def contract_match(spark, path):
    return _summed(_edges(spark, path)[1])


@query("routes", f", {_MATCH} {_GROUPED} WHERE confidence = 'suffix match' GROUP BY ALL")
def contract_suffix(spark, path):
    return _summed(_edges(spark, path)[1].filter("confidence = 'suffix match'"))


@query("routes", f", {_MATCH} SELECT service, file, line, path FROM p WHERE (file, line) NOT IN (SELECT (pf, pl) FROM edges)")
def orphan_routes(spark, path):
    return contracts.orphan_routes(*_edges(spark, path)).select("service", "file", "line", "path")


@query("routes", f", {_MATCH} SELECT service, file, line, path FROM c WHERE (file, line) NOT IN (SELECT (cf, cl) FROM edges)")
def orphan_calls(spark, path):
    return contracts.orphan_calls(*_edges(spark, path)).select("service", "file", "line", "path")


@query(
    "routes",
    f""", {_MATCH},
        listed AS (
            SELECT from_service AS "from", to_service AS "to", 'internal' AS kind, path, method, confidence, count(*) AS n
            FROM edges GROUP BY ALL
            UNION ALL
            SELECT service, 'outside this project', 'external', path, method, 'outside', count(*) FROM c
            WHERE (file, line) NOT IN (SELECT (cf, cl) FROM edges) GROUP BY ALL),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY "from", "to", kind ORDER BY path, coalesce(method, ''), confidence) AS rank
                    FROM listed)
        SELECT "from", "to", kind, CAST(sum(n) AS BIGINT) AS "count",
               string_agg(path, ' ' ORDER BY rank) FILTER (rank <= 12) AS routes
        FROM ordered GROUP BY "from", "to", kind""",
)
def service_map(spark, path):
    sites, edges = _edges(spark, path)
    outside = contracts.orphan_calls(sites, edges).withColumn("base_name", F.lit(None).cast("string"))
    links = contracts.service_links(edges, outside)
    return links.withColumn("routes", F.array_join(F.transform("routes", lambda r: r["path"]), " "))


@query(
    "routes",
    f""", {_MATCH} SELECT CASE WHEN to_service = 'example.com' THEN 'upstream' ELSE 'downstream' END AS role,
             from_service AS "from", to_service AS "to", count(*) AS "count" FROM edges
        WHERE 'example.com' IN (from_service, to_service) GROUP BY ALL""",
)
def service_map_focus(spark, path):
    """The neighbourhood of one service on the map."""
    sites, edges = _edges(spark, path)
    nothing = sites.filter(F.lit(False)).withColumn("base_name", F.lit(None).cast("string"))
    links = contracts.focused(contracts.service_links(edges, nothing), "example.com")
    return links.select("role", "from", "to", "count")
