"""HTTP contracts: finding both halves in source text, and pairing them.

Pairing runs between groups of sites that cannot be told apart (same path,
service, method and shape), each with the number of sites it stands for. A path
half the project uses is then a handful of rows, and the number of edges between
two groups is a product instead of a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from .ordering import top_per

OUTSIDE = "outside this project"


# Scanning -------------------------------------------------------------------
def _hits(text: Column, lines: Column, spec: dict, side: str) -> Column:
    """One pattern's matches in a text as an array of structs, with their line numbers.

    The line of match k follows from the line breaks in the pieces and matches before it.
    """
    pattern = F.lit(spec["re"])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    path = F.regexp_extract_all(text, pattern, F.lit(spec["path"]))
    method_group = spec.get("method") or spec.get("methods_in")
    method = F.regexp_extract_all(text, pattern, F.lit(method_group)) if method_group else whole
    gaps = F.transform(F.split(text, spec["re"], -1), tx.newlines)
    inner = F.transform(whole, tx.newlines)

    def total(counts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(counts, F.lit(1), n), F.lit(0), lambda acc, x: acc + x)

    def shape(_match: Column, i: Column) -> Column:
        raw = F.get(path, i)
        base = tx.base_expression(raw) if side == "consumes" else F.lit(None).cast("string")
        named = F.lit("")
        if spec.get("method"):
            named = F.upper(F.get(method, i))
        elif spec.get("methods_in"):
            named = F.upper(F.regexp_extract(F.get(method, i), f"(?i)({fixed.METHODS})", 1))
        return F.struct(
            F.lit(side).alias("side"),
            (F.lit(1) + total(gaps, i + 1) + total(inner, i)).alias("line"),
            F.nullif(named, F.lit("")).alias("method"),
            (tx.without_base(raw) if side == "consumes" else raw).alias("raw"),
            base.alias("base"),
            F.lit(bool(spec.get("via_wrapper"))).alias("via_wrapper"),
        )

    return F.transform(whole, shape)


def scan(files: DataFrame) -> DataFrame:
    """Route halves in `files` (service, file, text), `sources.schemas.ROUTES` shaped.

    Everything is JVM-side; files without a route-shaped literal are dropped before
    any pattern runs.
    """
    likely = files.filter(F.col("text").rlike(fixed.ROUTE_PREFILTER)).withColumn("_lines", F.split("text", r"\r?\n"))
    specs = [(s, "provides") for s in fixed.PROVIDER_PATTERNS] + [(s, "consumes") for s in fixed.CONSUMER_PATTERNS]
    found = F.concat(*[_hits(F.col("text"), F.col("_lines"), spec, side) for spec, side in specs])
    sites = (
        likely.select("service", "file", "_lines", F.posexplode(found).alias("_pos", "_h"))
        .select("service", "file", "_pos", F.get("_lines", F.col("_h.line") - 1).alias("_text"), "_h.*")
        .filter((F.col("raw") != "") & tx.is_route("raw") & ~tx.is_comment(F.coalesce("_text", F.lit(""))))
        .select(
            "side", "service", "file", "line", "method", tx.normalise_path("raw").alias("path"), "raw", "base",
            tx.base_name("base").alias("base_name"), F.col("raw").rlike(fixed.ROUTE_DYNAMIC).alias("dynamic"),
            "via_wrapper", F.substring(F.trim("_text"), 1, 160).alias("text"), "_pos",
        )
    )
    # A declaration is not a call to itself, whichever consumer pattern saw it.
    declared = sites.filter("side = 'provides'").select("service", "file", "line").distinct()
    provides = sites.filter("side = 'provides'")
    consumes = sites.filter("side = 'consumes'").join(declared, ["service", "file", "line"], "left_anti")
    return distinct_sites(provides.unionByName(consumes)).drop("_pos")


def distinct_sites(sites: DataFrame) -> DataFrame:
    """One row per (side, service, file, line, method, path); the earliest pattern wins."""
    keys = ["side", "service", "file", "line", "method", "path"]
    rest = [c for c in sites.columns if c not in keys]
    return (
        sites.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col("_pos")).alias("_row"))
        .select(*keys, "_row.*")
        .select(*sites.columns)
    )


# Matching -------------------------------------------------------------------
def _suffixes(path: Column) -> Column:
    """Every proper suffix of a path that starts with a slash."""
    parts = F.split(path, "/")
    return F.transform(
        F.when(F.size(parts) > 2, F.sequence(F.lit(3), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")),
    )


def _groups(sites: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return sites.filter(F.col("side") == side).groupBy(*keys).agg(F.count(F.lit(1)).alias("sites"))


def match(sites: DataFrame) -> DataFrame:
    """Contract edges between groups of sites.

    Columns: path, method, from_service, to_service, cross_service, confidence, calls
    and routes (sites on either side), edges (calls * routes), plus the keys of both
    groups (`c_*`, `p_*`).
    """
    provided = _groups(sites, "provides", ["path", "service", "method", "dynamic"]).select(
        F.col("path").alias("p_path"), F.col("service").alias("p_service"), F.col("method").alias("p_method"),
        F.col("dynamic").alias("p_dynamic"), F.col("sites").alias("routes"),
    )
    called = _groups(sites, "consumes", ["path", "service", "method", "dynamic", "via_wrapper"]).select(
        F.col("path").alias("c_path"), F.col("service").alias("c_service"), F.col("method").alias("c_method"),
        F.col("dynamic").alias("c_dynamic"), F.col("via_wrapper").alias("c_wrapper"), F.col("sites").alias("calls"),
    )
    paths = provided.select(F.col("p_path").alias("c_path")).distinct()
    exact = called.join(paths, "c_path", "left_semi").withColumn("by_suffix", F.lit(False)).withColumn("key", F.col("c_path"))
    tail = (
        called.filter("c_wrapper").join(paths, "c_path", "left_anti")
        .withColumn("by_suffix", F.lit(True)).withColumn("key", F.col("c_path"))
    )
    by_path = provided.withColumn("key", F.col("p_path")).withColumn("by_suffix", F.lit(False))
    by_tail = provided.withColumn("key", F.explode(_suffixes(F.col("p_path")))).withColumn("by_suffix", F.lit(True))
    offers = by_path.unionByName(by_tail)
    # At most the seven verbs per key.
    verbs = offers.filter("p_method is not null").groupBy("key", "by_suffix").agg(F.collect_set("p_method").alias("verbs"))
    asking = exact.unionByName(tail).join(verbs, ["key", "by_suffix"], "left")
    agreed = F.coalesce(F.array_contains("verbs", F.col("c_method")), F.lit(False))
    pairs = (
        asking.withColumn("agreed", agreed)
        .join(offers, ["key", "by_suffix"])
        .filter(~F.col("agreed") | (F.col("p_method") == F.col("c_method")))
    )
    confidence = (
        F.when(F.col("by_suffix"), "suffix match")
        .when(F.col("c_method").isNull(), "path only")
        .when(F.col("c_dynamic") | F.col("p_dynamic"), "pattern match")
        .otherwise("literal match")
    )
    both = F.col("c_service").isNotNull() & F.col("p_service").isNotNull()
    return pairs.select(
        F.col("p_path").alias("path"), F.coalesce("p_method", "c_method").alias("method"),
        F.col("c_service").alias("from_service"), F.col("p_service").alias("to_service"),
        (both & (F.col("c_service") != F.col("p_service"))).alias("cross_service"), confidence.alias("confidence"),
        "calls", "routes", (F.col("calls") * F.col("routes")).alias("edges"),
        "c_path", "c_method", "c_dynamic", "c_wrapper", "p_method", "p_dynamic",
    )


def _used(sites: DataFrame, side: str, edges: DataFrame) -> DataFrame:
    """Sites of one side whose group takes part in an edge."""
    if side == "provides":
        keys = {"path": "path", "service": "to_service", "method": "p_method", "dynamic": "p_dynamic"}
    else:
        keys = {
            "path": "c_path", "service": "from_service", "method": "c_method", "dynamic": "c_dynamic",
            "via_wrapper": "c_wrapper",
        }
    groups = edges.select(*[F.col(v).alias(f"_{k}") for k, v in keys.items()]).distinct()
    mine = sites.filter(F.col("side") == side)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return mine.join(groups, same, "left_semi")


def orphan_routes(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared routes nothing calls; a line with one used declaration is used."""
    used = _used(sites, "provides", edges).select("service", "file", "line").distinct()
    mine = sites.filter("side = 'provides'")
    return mine.join(used.withColumnRenamed("service", "_s").withColumnRenamed("file", "_f").withColumnRenamed("line", "_l"),
                     F.col("service").eqNullSafe(F.col("_s")) & (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")),
                     "left_anti")


def orphan_calls(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls nothing here answers; a line with one paired call is paired."""
    paired = _used(sites, "consumes", edges).select("file", "line").distinct()
    return sites.filter("side = 'consumes'").join(paired, ["file", "line"], "left_anti")


def site_edges(sites: DataFrame, edges: DataFrame, path: str | None = None) -> DataFrame:
    """The edges of group pairs spelled out site by site, for one path.

    Without `path` this lists every pair of sites of the project, which for a widely
    shared path is the product of its two sides.
    """
    if path is not None:
        edges = edges.filter(F.col("path") == path)
    calls = sites.filter("side = 'consumes'").select(
        F.col("path").alias("_cp"), F.col("service").alias("_cs"), F.col("method").alias("_cm"),
        F.col("dynamic").alias("_cd"), F.col("via_wrapper").alias("_cw"),
        F.col("file").alias("from_file"), F.col("line").alias("from_line"), F.col("text").alias("from_text"),
    )
    serves = sites.filter("side = 'provides'").select(
        F.col("path").alias("_pp"), F.col("service").alias("_ps"), F.col("method").alias("_pm"),
        F.col("dynamic").alias("_pd"),
        F.col("file").alias("to_file"), F.col("line").alias("to_line"), F.col("text").alias("to_text"),
    )
    caller = (
        (F.col("c_path") == F.col("_cp")) & F.col("from_service").eqNullSafe(F.col("_cs"))
        & F.col("c_method").eqNullSafe(F.col("_cm")) & (F.col("c_dynamic") == F.col("_cd"))
        & (F.col("c_wrapper") == F.col("_cw"))
    )
    server = (
        (F.col("path") == F.col("_pp")) & F.col("to_service").eqNullSafe(F.col("_ps"))
        & F.col("p_method").eqNullSafe(F.col("_pm")) & (F.col("p_dynamic") == F.col("_pd"))
    )
    return edges.join(calls, caller).join(serves, server).select(
        F.lit("http").alias("kind"), "method", "path", "from_service", "from_file", "from_line", "from_text",
        "to_service", "to_file", "to_line", "to_text", "cross_service", "confidence",
    )


def verified(edges: DataFrame, source_lines: DataFrame) -> DataFrame:
    """Edges whose two lines still read as they did when the edge was inferred."""
    now = source_lines.select("file", "line", F.substring(F.trim("text"), 1, 160).alias("_text"))
    for end in ("from", "to"):
        here = now.select(*[F.col(c).alias(f"_{end}{c}") for c in ("file", "line", "_text")])
        same = (
            (F.col(f"{end}_file") == F.col(f"_{end}file")) & (F.col(f"{end}_line") == F.col(f"_{end}line"))
            & (F.col(f"{end}_text") == F.col(f"_{end}_text"))
        )
        edges = edges.join(here, same, "left_semi")
    return edges


# Reading --------------------------------------------------------------------
def service_links(edges: DataFrame, calls_outside: DataFrame, project: str = "project", routes: int = 12) -> DataFrame:
    """(from, to, kind, count, routes): who talks to whom, with the first few routes that say so.

    Outside services are known by the name calls address them with.
    """
    inside = edges.select(
        F.coalesce("from_service", F.lit(project)).alias("from"), F.coalesce("to_service", F.lit(project)).alias("to"),
        F.lit("internal").alias("kind"), "method", "path", "confidence", F.col("edges").alias("n"),
    )
    outside = calls_outside.select(
        F.coalesce("service", F.lit(project)).alias("from"),
        F.coalesce(F.nullif("base_name", F.lit("")), F.lit(OUTSIDE)).alias("to"),
        F.lit("external").alias("kind"), "method", "path", F.lit("outside").alias("confidence"), F.lit(1).alias("n"),
    )
    listed = inside.unionByName(outside).groupBy("from", "to", "kind", "path", "method", "confidence").agg(F.sum("n").alias("n"))
    counted = listed.groupBy("from", "to", "kind").agg(F.sum("n").alias("count"))
    order = [F.col("path"), F.coalesce("method", F.lit("")), F.col("confidence")]
    shown = top_per(listed, ["from", "to", "kind"], order, routes).groupBy("from", "to", "kind").agg(
        F.array_sort(F.collect_list(F.struct("rank", "method", "path", "confidence"))).alias("routes")
    )
    return counted.join(shown, ["from", "to", "kind"])


def focused(links: DataFrame, service: str) -> DataFrame:
    """Only the links that touch one service, with the side the other end is on."""
    touching = links.filter((F.col("from") == service) | (F.col("to") == service))
    return touching.withColumn("role", F.when(F.col("to") == service, "upstream").otherwise("downstream"))


def flow(pairs: DataFrame, symbols: DataFrame, edges: DataFrame, downstream: int = 12) -> DataFrame:
    """Each site edge of a route with its calling symbol, its handler and what the handler calls next."""
    from .spans import enclosing, symbol_spans

    spans = symbol_spans(symbols)
    rows = pairs.select(F.struct(*pairs.columns).alias("e"), F.col("from_file").alias("file"), F.col("from_line").alias("line"))
    rows = enclosing(rows, spans).select("e", F.col("node_id").alias("caller"), F.col("e.to_file").alias("file"), F.col("e.to_line").alias("line"))
    rows = enclosing(rows, spans).select("e.*", "caller", F.col("node_id").alias("handler"))
    handlers = rows.select(F.col("handler").alias("src")).distinct()
    order = [F.coalesce("line", F.lit(0)), F.col("dst")] if "line" in edges.columns else [F.col("dst")]
    next_calls = top_per(edges.join(handlers, "src", "left_semi"), ["src"], order, downstream)
    called = next_calls.groupBy(F.col("src").alias("handler")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda s: s["dst"]).alias("downstream")
    )
    return rows.join(called, "handler", "left")


