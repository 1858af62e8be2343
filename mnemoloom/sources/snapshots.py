"""Writing tables: appends, per-project replacement, snapshots and transfer bundles.

Everything is parquet. A replacement is written beside what it replaces and becomes
current by claiming the next version number, so a reader sees the old table or the new one
and of two writers that started from one version the second is told.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.memory import merge_facts

# What a bundle carries, and what the receiving side derives again for itself.
BUNDLE_TABLES = ("facts", "scenarios", "personas", "pending", "projects")
DERIVED_TABLES = ("symbols", "edges", "repos", "contract_edges", "contract_orphans", "usage")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def log_usage(spark: SparkSession, path: str, tool: str, in_chars: int, out_chars: int, baseline: int = 0) -> None:
    """Record one call's measured sizes. Metering never gets in the way of the call."""
    try:
        row = spark.range(1).select(
            F.current_timestamp().alias("at"), F.lit(tool).alias("tool"), F.lit(int(in_chars)).cast("bigint").alias("in_chars"),
            F.lit(int(out_chars)).cast("bigint").alias("out_chars"), F.lit(int(baseline)).cast("bigint").alias("baseline_chars"),
        )
        append(row, path)
    except Exception:  # noqa: BLE001
        pass


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of `key` present in `df` and leave the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


# Snapshots ------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


class Conflict(RuntimeError):
    """Somebody else has published since the version that an update was made from."""


def _pointer(version: int) -> str:
    return f"v{version:012d}"


def version(spark: SparkSession, root: str) -> int:
    """Number of the current snapshot; 0 before the first."""
    fs, path_of = _fs(spark, root)
    folder = path_of(f"{root}/_versions")
    if not fs.exists(folder):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return max((int(n[1:]) for n in names if n.startswith("v")), default=0)


def _claim(spark: SparkSession, root: str, number: int, text: str) -> bool:
    """Make `text` the pointer of a version, unless there is one. A rename that does not overwrite decides between writers."""
    jvm = spark.sparkContext._jvm
    fs, path_of = _fs(spark, root)
    draft, final = path_of(f"{root}/_versions/.draft-{uuid.uuid4().hex}"), path_of(f"{root}/_versions/{_pointer(number)}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(draft, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:  # py4j wraps what the file system throws
        if not fs.exists(final):
            raise
        fs.delete(draft, False)
        if "Exists" not in str(e) and "exists" not in str(e):
            raise
        return False


def publish(df: DataFrame, root: str, expected: int | None = None, partition_by: str | None = None) -> int:
    """Write a new snapshot below `root`, make it current and return its version.

    With `expected`, the version that `df` was made from, a snapshot published in between is a `Conflict` and nothing
    changes; without, this one comes after whatever is current. `partition_by` lays the files out by a column, so
    that a filter on it reads only its part.
    """
    spark = df.sparkSession
    name = f"snapshot-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(f"{root}/{name}")
    text = json.dumps({"name": name, "schema": df.schema.jsonValue()})
    while True:
        base = version(spark, root) if expected is None else expected
        if _claim(spark, root, base + 1, text):
            return base + 1
        if expected is not None:
            raise Conflict(f"{root}: version {expected} is no longer current")


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The latest published snapshot, or that of a version."""
    fs, path_of = _fs(spark, root)
    at = path_of(f"{root}/_versions/{_pointer(number or version(spark, root))}")
    stream = fs.open(at)
    try:
        pointer = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    schema = T.StructType.fromJson(pointer["schema"])
    return spark.read.schema(schema).parquet(f"{root}/{pointer['name']}").select(schema.names)


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], partition_by: str | None = None, tries: int = 8) -> int:
    """Publish what `change` makes of the current snapshot (none before the first), again from the new one if somebody else was faster."""
    for _ in range(tries):
        base = version(spark, root)
        try:
            return publish(change(current(spark, root, base) if base else None), root, base, partition_by)
        except Conflict:
            continue
    raise Conflict(f"{root}: gave up after {tries} tries")


# Graph import ---------------------------------------------------------------
def import_graph(symbols: DataFrame, previous: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(symbols, changes) of a rebuilt graph: vectors of unchanged symbols are kept.

    Unchanged means label, file, signature, doc and context are. `changes` is
    (repo, node_id, change): new, kept, changed or gone.
    """
    base = symbols.drop("embedding") if "embedding" in symbols.columns else symbols
    if previous is None:
        out = base.withColumn("embedding", F.lit(None).cast("array<float>"))
        return out, out.select("repo", "node_id", F.lit("new").alias("change"))
    compared = ("label", "file", "signature", "doc", "context")
    old = previous.select("repo", "node_id", F.struct(*compared).alias("_was"), "embedding", F.lit(True).alias("_known"))
    both = base.join(old, ["repo", "node_id"], "left")
    same = F.coalesce(F.col("_known") & F.struct(*compared).eqNullSafe(F.col("_was")), F.lit(False))
    out = both.withColumn("embedding", F.when(same, F.col("embedding"))).select(*base.columns, "embedding")
    change = F.when(F.col("_known").isNull(), "new").when(same, "kept").otherwise("changed")
    gone = old.join(base.select("repo", "node_id"), ["repo", "node_id"], "left_anti")
    gone = gone.join(base.select("repo").distinct(), "repo", "left_semi")
    return out, both.select("repo", "node_id", change.alias("change")).unionByName(gone.select("repo", "node_id", F.lit("gone").alias("change")))


def forget(df: DataFrame, key: str, value) -> DataFrame:
    """The table without one project, repository or session."""
    return df.filter(~F.col(key).eqNullSafe(F.lit(value)))


# Contracts ------------------------------------------------------------------
def save_contracts(project: str, edges: DataFrame, routes: DataFrame, calls: DataFrame, root: str) -> None:
    """Store a project's contract edges and orphans, replacing what it had."""
    replace_partitions(edges.withColumn("project", F.lit(project)), f"{root}/contract_edges", "project")
    columns = ["method", "path", "service", "file", "line"]
    lone = routes.select(F.lit("route").alias("side"), *columns, F.lit(None).cast("string").alias("base_name")).unionByName(
        calls.select(F.lit("call").alias("side"), *columns, "base_name")
    )
    replace_partitions(lone.withColumn("project", F.lit(project)), f"{root}/contract_orphans", "project")


def load_contracts(spark: SparkSession, project: str, root: str) -> tuple[DataFrame, DataFrame]:
    """(edges by path, orphans) of one project; the filter prunes to its partition."""
    mine = F.col("project") == project
    edges = spark.read.parquet(f"{root}/contract_edges").filter(mine).orderBy("path")
    return edges, spark.read.parquet(f"{root}/contract_orphans").filter(mine)


# Bundles --------------------------------------------------------------------
def export_bundle(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Write the portable tables and a manifest; derived ones stay behind."""
    carried = [t for t in BUNDLE_TABLES if t in tables]
    for name in carried:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = {
        "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "carried": carried,
        "notCarried": [t for t in DERIVED_TABLES if t in tables],
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return carried


def import_bundle(spark: SparkSession, folder: str, mine: dict[str, DataFrame], replace: bool = False, threshold: float = 0.88) -> dict[str, DataFrame]:
    """The tables this store should hold after taking a bundle in.

    An empty store, or `replace`, takes the facts whole with their history. Otherwise the
    live ones it does not know are added under new ids, and queue and log stay behind.
    Projects are a union.
    """
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    theirs = {t: spark.read.parquet(f"{folder}/{t}") for t in manifest["carried"]}
    out = dict(mine)
    if "projects" in theirs:
        out["projects"] = theirs["projects"].unionByName(mine["projects"]).distinct() if "projects" in mine else theirs["projects"]
    if "facts" not in theirs:
        return out
    if replace or "facts" not in mine or mine["facts"].isEmpty():
        out.update({t: df for t, df in theirs.items() if t != "projects"})
        return out
    from ..operators.ordering import dense_index

    fresh = merge_facts(mine["facts"], theirs["facts"], threshold)
    top = mine["facts"].agg(F.max("id").alias("m")).scalar()
    numbered = dense_index(fresh, "id", "_n").withColumn("id", top + F.col("_n")).drop("_n")
    # Chains of replacement point at ids of the other store; what they resolve to is what came along.
    dropped = [c for c in ("superseded_by", "superseded_at", "task_id") if c in numbered.columns]
    out["facts"] = mine["facts"].unionByName(numbered.drop(*dropped), allowMissingColumns=True)
    return out


