"""Reading the documents the tables are made from.

Readers split their input where the format allows it (a commit, a file's diff, a line),
so one large log is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from .schemas import GRAPH_DOCUMENT


# Graph documents ------------------------------------------------------------
def graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of node-link JSON documents; links without both ends are left out.

    Missing labels are ids, missing files empty, missing relations calls. `repo` is the
    document's own path, so several documents can be read at once.
    """
    docs = spark.read.schema(GRAPH_DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    docs = docs.withColumn("repo", F.input_file_name())
    n = docs.select("repo", F.explode("nodes").alias("n"))
    label = F.coalesce("n.label", "n.id")
    symbols = n.select(
        "repo", F.col("n.id").alias("node_id"), tx.bare_name(label).alias("name"), label.alias("label"),
        F.coalesce("n.source_file", F.lit("")).alias("file"), tx.line_of("n.source_location").alias("line"),
        F.coalesce("n._callable", F.lit(False)).alias("callable"),
    )
    links = docs.select("repo", F.explode("links").alias("l")).select(
        "repo", F.col("l.source").alias("src"), F.col("l.target").alias("dst"),
        F.coalesce("l.relation", F.lit("calls")).alias("relation"), F.col("l.source_file").alias("file"),
        tx.line_of("l.source_location").alias("line"),
    )
    ends = symbols.select("repo", "node_id", F.col("file").alias("_home"))
    edges = links.join(ends.withColumnRenamed("node_id", "src"), ["repo", "src"]).join(
        symbols.select("repo", F.col("node_id").alias("dst")), ["repo", "dst"], "left_semi"
    )
    return symbols, edges.select("repo", "src", "dst", "relation", F.coalesce(F.nullif("file", F.lit("")), "_home").alias("file"), "line")


def build_commit(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(GRAPH_DOCUMENT).option("multiLine", True).json(path)
    return docs.select(F.input_file_name().alias("repo"), "built_at_commit")


def clustering(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((community, node_id), (community, label)) from a clustering sidecar; empty maps give no rows."""
    schema = "communities map<string,array<string>>, labels map<string,string>, cohesion map<string,double>"
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    members = docs.select(F.explode("communities").alias("community", "_m")).select("community", F.explode("_m").alias("node_id"))
    return members, docs.select(F.explode("labels").alias("community", "label"))


# Conversations --------------------------------------------------------------
def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, position, role, content) of JSONL transcripts.

    Only what the user and the assistant said: tool traffic, blank turns, turns opening
    with a tag and unreadable lines are skipped. `position` grows along a file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    row = lines.withColumn("_v", F.try_parse_json("value")).filter("_v is not null")
    msg = F.coalesce(F.try_variant_get("_v", "$.message", "variant"), F.col("_v"))
    row = row.withColumn("_m", msg)
    role = F.coalesce(F.try_variant_get("_m", "$.role", "string"), F.try_variant_get("_v", "$.type", "string"))
    content = F.try_variant_get("_m", "$.content", "variant")
    blocks = F.from_json(F.to_json(content), "array<struct<type:string,text:string>>")
    spoken = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    kind = F.schema_of_variant(content)
    said = F.when(kind == "STRING", F.try_variant_get("_m", "$.content", "string")).when(kind.startswith("ARRAY"), spoken)
    clean = F.regexp_replace(F.coalesce(said, F.lit("")), r"^\s+|\s+$", "")
    # Lines of a block are numbered in reading order; a block starts further into the file than the ones before.
    within = F.col("_id").bitwiseAND(F.lit((1 << 26) - 1))
    position = F.shiftleft(F.col("_block").cast("bigint"), 26) + within
    return (
        row.select("session", position.alias("position"), role.alias("role"), clean.alias("content"))
        .filter(F.col("role").isin("user", "assistant") & (F.col("content") != "") & ~F.col("content").startswith("<"))
    )


def recent_files(spark: SparkSession, path: str, limit: int = 8, pattern: str = "*.jsonl") -> DataFrame:
    """(file, bytes, at) of the newest files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("at")).orderBy(
        F.col("at").desc(), "file"
    ).limit(limit)


# History --------------------------------------------------------------------
def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, at, author, file) from `git log --no-merges --name-only --format=%x01%H%x02%at%x02%an`.

    The log is split at its commit marks while it is read. A commit without files has no rows.
    """
    chunks = spark.read.option("lineSep", "\x01").text(path).filter(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    head = F.split(lines[0], "\x02")
    files = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), F.trim), lambda s: s != "")
    return chunks.select(
        head[0].alias("commit"), F.coalesce(head[1].cast("bigint"), F.lit(0)).alias("at"), F.get(head, F.lit(2)).alias("author"),
        F.explode(files).alias("file"),
    )


def unified_diff(spark: SparkSession, path: str) -> DataFrame:
    """(file, lo, hi) touched on the new side of `git diff -U0` output, read one file's diff at a time.

    A hunk without a length is one line; a removal has hi = lo - 1.
    """
    chunks = spark.read.option("lineSep", "diff --git ").text(path)
    return diff_ranges(chunks)


def diff_ranges(chunks: DataFrame, value: str = "value") -> DataFrame:
    """The same over a table of per-file diffs, other columns kept."""
    kept = [c for c in chunks.columns if c != value]
    file = F.regexp_replace(F.regexp_extract(value, r"(?m)^\+\+\+ b/(.+)$", 1), r"\r$", "")
    hunk = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"
    hunks = F.regexp_extract_all(value, F.lit(hunk), F.lit(1))
    start = F.split("_h", ",")[0].cast("int")
    count = F.coalesce(F.get(F.split("_h", ","), F.lit(1)).cast("int"), F.lit(1))
    rows = chunks.select(*kept, file.alias("file"), F.explode(hunks).alias("_h")).filter("file <> ''")
    return rows.select(*kept, "file", start.alias("lo"), (start + count - 1).alias("hi"))


def changed_files(chunks: DataFrame, value: str = "value") -> DataFrame:
    """(file) from `git diff --name-only` lines."""
    return chunks.select(F.trim(value).alias("file")).filter("file <> ''")


# Trees ----------------------------------------------------------------------
def _depth(root: str):
    below = F.regexp_replace(F.col("path"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return F.size(F.split(below, "/")) - 1


def _relative(root: str):
    at = F.locate(root.rstrip("/") + "/", F.col("path"))
    return F.substring(F.col("path"), at + F.lit(len(root.rstrip("/")) + 1), F.length("path"))


def source_tree(spark: SparkSession, root: str, service: str | None = None, max_bytes: int = 400_000, max_depth: int = 8) -> DataFrame:
    """(service, file, text) of code files, generated directories and large files left out.

    The size filter reaches the scan, so a large file is not read to be dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = _relative(root)
    keep = (
        (F.col("length") <= max_bytes) & rel.rlike(fixed.CONTRACT_CODE_EXT) & ~rel.rlike(fixed.CONTRACT_SKIP_DIR)
        & (F.size(F.split(rel, "/")) - 1 <= max_depth)
    )
    return files.filter(keep).select(F.lit(service).alias("service"), rel.alias("file"), F.decode("content", "UTF-8").alias("text"))


def named_files(spark: SparkSession, root: str, pattern: str = "*.md", max_depth: int = 5, hidden: bool = False) -> DataFrame:
    """(file, text) of files matching a name pattern, near the root, outside generated directories."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    rel = _relative(root)
    dirs = F.slice(F.split(rel, "/"), F.lit(1), F.size(F.split(rel, "/")) - 1)
    skip = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in fixed.SPEC_SKIP_DIRS]))
    dotted = F.exists(dirs, lambda d: d.startswith(".")) if not hidden else F.lit(False)
    return files.filter(~skip & ~dotted & (F.size(dirs) <= max_depth)).select(rel.alias("file"), F.decode("content", "UTF-8").alias("text"))


def source_lines(files: DataFrame) -> DataFrame:
    """(file, line, text) of files (file, text), lines counted from one."""
    return files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("_i", "text")).select(
        "file", (F.col("_i") + 1).alias("line"), "text"
    )


def path_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of everything under a root: what the path checks and size reports look things up in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("bytes"))


def directory_bytes(inventory: DataFrame, dirs: DataFrame) -> DataFrame:
    """(dir, bytes) below each directory. A file is charged to its ancestors by equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    spread = inventory.select(F.explode(above).alias("dir"), "bytes").groupBy("dir").agg(F.sum("bytes").alias("bytes"))
    return dirs.select("dir").distinct().join(spread, "dir", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))


# Registries and logs --------------------------------------------------------
def registry(spark: SparkSession, path: str) -> DataFrame:
    """(key, path) of registered projects; a malformed file or entry gives no row."""
    docs = spark.read.text(path, wholetext=True)
    listed = F.from_json(F.get_json_object("value", "$.projects"), "array<string>")
    rows = docs.select(F.explode(listed).alias("path")).filter(F.col("path").isNotNull() & F.col("path").rlike(r"^[^{\[\d]"))
    return rows.select(registry_key("path").alias("key"), "path")


def registry_key(path: str):
    """base64url of a path, unpadded."""
    return F.translate(F.rtrim(F.translate(F.base64(F.encode(F.col(path), "UTF-8")), "\r\n=", "")), "+/", "-_")


def streams(spark: SparkSession, path: str) -> DataFrame:
    """Registered work streams, keyed by repository name and stream name."""
    record = "name string, repo string, path string, branch string, base string, baseAt string, pinned boolean, evaluated boolean, evaluatedAt string"
    docs = spark.read.schema(f"streams map<string, struct<{record.replace(' ', ':').replace(',:', ', ')}>>").option("multiLine", True).json(path)
    rows = docs.select(F.explode("streams").alias("_k", "_s")).select("_s.*")
    return rows.withColumn("key", F.concat(tx.basename("repo"), F.lit("::"), "name"))


def output_lines(spark: SparkSession, path: str) -> DataFrame:
    """(run, n, text) of captured command output, one run per file.

    A file is one run and is read whole, so that its lines keep their numbers.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("run"), "value")
    return files.select("run", F.posexplode(F.split("value", r"\r?\n")).alias("n", "text"))
