"""Looking around a project: workspace union, tree, overview, impact of a diff, one symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from . import graph
from .spans import enclosing, in_ranges, symbol_spans


def workspace(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph from tables holding several services': ids become service::id, files service/file.

    Both tables carry a `service` column; two services may use the same ids.
    """

    def relocated(df: DataFrame, ids: list[str]) -> DataFrame:
        for c in ids:
            df = df.withColumn(c, F.concat("service", F.lit("::"), F.col(c).cast("string")))
        if "file" not in df.columns:
            return df
        place = F.concat("service", F.lit("/"), F.translate("file", "\\", "/"))
        return df.withColumn("file", F.when(F.coalesce("file", F.lit("")) == "", F.lit("")).otherwise(place))

    return relocated(symbols, ["node_id"]), relocated(edges, ["src", "dst"])


def with_contracts(edges: DataFrame, symbols: DataFrame, contracts: DataFrame) -> DataFrame:
    """Edges plus the HTTP contracts between the symbols holding their two lines.

    `contracts` is (from_file, from_line, to_file, to_line, path, method, confidence).
    """
    spans = symbol_spans(symbols)
    call = contracts.select(F.struct(*contracts.columns).alias("c"), F.col("from_file").alias("file"), F.col("from_line").alias("line"))
    call = enclosing(call, spans).filter("node_id is not null").select("c", F.col("node_id").alias("src"))
    serve = call.select("c", "src", F.col("c.to_file").alias("file"), F.col("c.to_line").alias("line"))
    both = enclosing(serve, spans).filter("node_id is not null and node_id <> src")
    added = both.select(
        "src", F.col("node_id").alias("dst"), F.col("c.from_file").alias("file"), F.col("c.from_line").alias("line"),
        F.lit(True).alias("via_contract"), F.col("c.path").alias("route"), F.col("c.method").alias("method"),
        F.col("c.confidence").alias("confidence"),
    )
    return edges.withColumn("via_contract", F.lit(False)).unionByName(added, allowMissingColumns=True)


def tree_counts(symbols: DataFrame) -> DataFrame:
    """(path, kind, symbols) of every project, directory and file, counts rolled up."""
    placed = symbols.filter((F.coalesce("file", F.lit("")) != "") & ~tx.is_file_node("name", "file"))
    per_file = placed.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    parts = F.filter(F.split("file", "/"), lambda p: p != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size("_parts")),
        lambda i: F.struct(F.array_join(F.slice("_parts", 1, i), "/").alias("path"), (i == F.size("_parts")).alias("leaf")),
    )
    exploded = per_file.select(parts.alias("_parts"), "n").select("n", F.explode(prefixes).alias("p"))
    return exploded.groupBy(F.col("p.path").alias("path")).agg(
        F.sum("n").alias("symbols"), F.bool_or("p.leaf").alias("_leaf")
    ).select("path", F.when(F.col("path") == "", "project").when(F.col("_leaf"), "file").otherwise("dir").alias("kind"), "symbols")


def tree_rows(symbols: DataFrame) -> DataFrame:
    """(path, name, parent, kind, symbols, children): the tree with chains of single directories folded.

    A directory that is its parent directory's only child, itself a directory, is
    drawn on the parent's row. A row keeps the path of the innermost directory and
    a name spelling the whole chain.
    """
    nodes = tree_counts(symbols)
    up = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    parent = F.when(F.col("path") != "", up)
    linked = nodes.withColumn("parent", parent)
    kids = linked.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(
        F.count(F.lit(1)).alias("children"), F.bool_and(F.col("kind") == "dir").alias("_only_dirs")
    )
    full = linked.join(kids, "path", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    # A directory holding exactly one directory disappears into it.
    folds = (F.col("kind") == "dir") & (F.col("children") == 1) & F.coalesce("_only_dirs", F.lit(False))
    marked = full.withColumn("_folds", folds)
    # Each row asks which of its ancestors fold, from the innermost outwards: one lookup table, joined on a path.
    depth = F.size(F.split("path", "/"))
    ancestors = marked.filter("path <> '' and not _folds").select(
        "*", F.explode(F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array(F.lit(0)))).alias("_d")
    ).withColumn("_anc", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("_d")), "/"))
    folding = marked.filter("_folds").select(F.col("path").alias("_anc"), F.lit(True).alias("_f"))
    stops = (
        ancestors.join(folding, "_anc", "left")
        .groupBy("path", "kind", "symbols", "children")
        # The deepest ancestor that does not fold is the row's parent; depth 0 is the project.
        .agg(F.max(F.when(F.col("_f").isNull(), F.col("_d"))).alias("_stop"))
        .withColumn("_stop", F.coalesce("_stop", F.lit(0)))
    )
    pieces = F.split("path", "/")
    shown = stops.select(
        "path",
        F.when(F.col("kind") == "dir", F.array_join(F.slice(pieces, F.col("_stop") + 1, F.size(pieces)), "/"))
        .otherwise(F.element_at(pieces, -1)).alias("name"),
        F.array_join(F.slice(pieces, F.lit(1), F.col("_stop")), "/").alias("parent"),
        "kind", "symbols",
    )
    counts = shown.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("children"))
    top = nodes.filter("path = ''").select(
        "path", F.lit("").alias("name"), F.lit(None).cast("string").alias("parent"), "kind", "symbols"
    )
    return shown.unionByName(top).join(counts, "path", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def tree(symbols: DataFrame, under: str = "", depth: int = 1) -> DataFrame:
    """The branch `under`, `depth` levels down, each row with its level and whether more lies below.

    An unknown branch has no rows.
    """
    rows = cut(tree_rows(symbols))
    level = cur = rows.filter(F.col("path") == under).withColumn("level", F.lit(0))
    for d in range(1, depth + 1):
        above = cur.select(F.col("path").alias("parent"))
        cur = rows.join(above, "parent", "left_semi").select(*rows.columns, F.lit(d).alias("level"))
        level = level.unionByName(cur)
    return level.withColumn("has_more", (F.col("level") == depth) & ((F.col("children") > 0) | (F.col("kind") == "file")))


def overview_counts(symbols: DataFrame, edges: DataFrame, communities: DataFrame | None = None, contracts: DataFrame | None = None) -> DataFrame:
    """(what, rows): symbols, edges, communities, contracts."""

    def count(df: DataFrame | None, what: str) -> DataFrame:
        if df is None:
            return symbols.sparkSession.createDataFrame([(what, 0)], "what string, rows bigint")
        return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(what).alias("what"), "rows")

    out = count(symbols, "symbols").unionByName(count(edges, "edges"))
    return out.unionByName(count(communities, "communities")).unionByName(count(contracts, "contracts"))


def communities(members: DataFrame, symbols: DataFrame, labels: DataFrame | None = None, limit: int = 40) -> DataFrame:
    """(community, label, size): clusters by size, named by their label or the directory most members live in.

    `members` is (community, node_id). Directories are counted before any ranking.
    """
    inside = members.join(symbols.select("node_id", "file"), "node_id")
    place = F.when(F.coalesce("file", F.lit("")) == "", None).otherwise(
        F.when(F.col("file").contains("/"), tx.dirname("file")).otherwise(F.lit(""))
    )
    by_dir = inside.groupBy("community", place.alias("_dir")).agg(F.count(F.lit(1)).alias("_n"))
    best = by_dir.groupBy("community").agg(
        F.sum("_n").alias("size"),
        F.min(F.when(F.col("_dir").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_dir").alias("d")))).alias("_b"),
    )
    named = F.when(F.col("_b").isNull(), "unplaced").when(F.col("_b.d") == "", "/").otherwise(F.col("_b.d"))
    out = best.select("community", named.alias("_place"), "size")
    out = out.join(labels, "community", "left") if labels is not None else out.withColumn("label", F.lit(None).cast("string"))
    return (
        out.select("community", F.coalesce("label", "_place").alias("label"), "size")
        .orderBy(F.col("size").desc(), "community")
        .limit(limit)
    )


def diff_impact(ranges: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Symbols a diff touched, most called first: (node_id, name, file, line, callers)."""
    touched = in_ranges(ranges, symbol_spans(symbols)).select("node_id")
    called = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("callers"))
    return (
        symbols.join(touched, "node_id", "left_semi")
        .join(called, "node_id", "left")
        .withColumn("callers", F.coalesce("callers", F.lit(0)))
        .orderBy(F.col("callers").desc(), "node_id")
        .limit(tx.clamp(limit, 1, 100))
        .select("node_id", "name", "file", "line", "callers")
    )


def unknown_files(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Changed files no symbol lives in."""
    known = symbols.select(F.translate("file", "\\", "/").alias("file")).distinct()
    return ranges.select("file").distinct().join(known, "file", "left_anti")


def detail(symbols: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, relation, other, other_name): callers and callees apart from the file that contains a symbol."""
    out = None
    for relation in ("callers", "callees"):
        near = graph.neighbours(edges, symbols, ids, relation).join(
            symbols.select(F.col("node_id").alias("of"), F.col("file").alias("_home")), "of"
        )
        container = tx.is_file_node("name", "file")
        kind = F.when(~container, F.lit(relation[:-1])).when(
            F.lit(relation == "callers") & (F.col("file") == F.col("_home")), F.lit("contained_by")
        )
        rows = near.select(
            F.col("of").alias("node_id"), kind.alias("relation"), F.col("node_id").alias("other"), F.col("name").alias("other_name")
        ).filter("relation is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def project_of(dirs: DataFrame, roots: DataFrame) -> DataFrame:
    """(dir, root): the most specific registered ancestor of each directory, or null.

    Every ancestor of a directory is an equi-join key, so no prefix comparison runs between tables.
    """
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    pairs = dirs.select("dir", F.explode(ancestors).alias("root")).join(roots.select("root").distinct(), "root")
    best = pairs.groupBy("dir").agg(F.max_by("root", F.length("root")).alias("root"))
    return dirs.select("dir").distinct().join(best, "dir", "left")


def service_status(services: DataFrame, repos: DataFrame) -> DataFrame:
    """Every service with what its index holds, zero where it has none. `repos` is (repo, symbols, edges, imported_at)."""
    joined = services.join(repos, services["path"] == repos["repo"], "left")
    return joined.select(
        "name", F.col("repo").isNotNull().alias("indexed"), F.coalesce("symbols", F.lit(0)).alias("symbols"),
        F.coalesce("edges", F.lit(0)).alias("edges"), "imported_at",
    )


def graph_summary(status: DataFrame) -> DataFrame:
    """Totals over indexed services; no row when nothing is indexed."""
    return (
        status.filter("indexed")
        .agg(F.count(F.lit(1)).alias("services"), F.sum("symbols").alias("symbols"), F.sum("edges").alias("edges"),
             F.max("imported_at").alias("imported_at"))
        .filter("services > 0")
    )


