"""Text formats: tables written as the documents they would come from, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import readers
from ..sources import views as v
from .registry import query


def _written(lines: DataFrame, *by: str) -> str:
    """A folder of text files holding the rows of `value`, apart by the other columns."""
    folder = shared_folder(lines.sparkSession, "text")
    lines.write.partitionBy(*by).text(folder)
    return folder


@query("commit_files", """SELECT CAST("commit" AS VARCHAR) AS "commit", "at", CAST(author AS VARCHAR) AS author, file FROM commit_files""")
def git_log_read(spark, path):
    """The history as a log of commits with their files, an entry per commit."""
    entries = v.commit_files(spark, path).groupBy("commit", "at", "author").agg(F.array_sort(F.collect_set("file")).alias("files"))
    head = F.concat_ws("\x02", F.concat(F.lit("\x01"), F.col("commit").cast("string")), F.col("at").cast("string"), F.col("author").cast("string"))
    lines = entries.select(F.concat(head, F.lit("\n\n"), F.array_join("files", "\n")).alias("value"))
    return readers.git_log(spark, _written(lines))


@query("ranges", "SELECT DISTINCT file, lo, hi - 1 AS hi FROM ranges")
def diff_read(spark, path):
    """Ranges as a unified diff without context: removals have no new lines, hunks of one line name no length."""
    length = F.col("hi") - F.col("lo")
    after = F.when(length == 1, F.col("lo").cast("string")).otherwise(F.concat_ws(",", F.col("lo").cast("string"), length.cast("string")))
    hunk = F.concat(F.lit("@@ -"), F.col("lo").cast("string"), F.lit(",2 +"), after, F.lit(" @@ near @@ -1 +1 @@\n-old\n+new"))
    # A file holds at most the hunks of 200 parts.
    files = v.ranges(spark, path).groupBy("file").agg(F.array_join(F.collect_set(hunk), "\n").alias("hunks"))
    name = F.col("file")
    text = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"), F.col("hunks"))
    gone = F.concat(F.lit("diff --git a/gone/"), name, F.lit(" b/gone/"), name, F.lit("\n--- a/gone\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-old"))
    return readers.unified_diff(spark, _written(files.select(F.explode(F.array(text, gone)).alias("value"))))


@query(
    "",
    r"""WITH said AS (SELECT CAST(conv_id % 4 AS INTEGER) AS part, role,
            CASE WHEN role = 'user' AND turn % 5 = 0 THEN '<command>' || text WHEN role = 'assistant' AND turn % 2 = 0 THEN text || E'\ndone' ELSE text END AS t
            FROM conversations WHERE role IN ('user', 'assistant')),
        clean AS (SELECT part, role, regexp_replace(t, '^\s+|\s+$', '', 'g') AS content FROM said)
        SELECT part, role, content FROM clean WHERE content <> '' AND NOT starts_with(content, '<')""",
)
def transcripts_read(spark, path):
    """Conversations as JSON lines: plain and block contents, calls of tools, commands, and lines cut short."""
    turns = v.table(spark, path, "conversations")
    text, even = F.coalesce("text", F.lit("")), F.col("turn") % 2 == 0
    block = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    blocks = F.array(block("text", text), block("tool_use", F.lit(None).cast("string")), block("text", F.lit("done")))
    said = F.when((F.col("role") == "user") & (F.col("turn") % 5 == 0), F.concat(F.lit("<command>"), text)).otherwise(text)
    role = F.col("role")
    wrapped = lambda content: F.to_json(F.struct(role.alias("type"), F.struct(role.alias("role"), content.alias("content")).alias("message")))
    line = (
        F.when(role == "user", wrapped(said))
        .when((role == "assistant") & even, wrapped(blocks))
        .when(role == "assistant", F.to_json(F.struct(role, text.alias("content"))))
        .otherwise(F.concat(F.lit('{"role": "user", "content": "cut '), F.translate(text, '\r\n"\\', "    ")))
    )
    rows = readers.transcripts(spark, _written(turns.select((F.col("conv_id") % 4).alias("part"), line.alias("value")), "part"))
    return rows.select(F.regexp_extract("session", r"part=(\d+)", 1).cast("int").alias("part"), "role", "content")


@query(
    "symbols",
    """, held AS (SELECT file, sum(line) AS bytes FROM symbols GROUP BY file),
        up AS (SELECT string_split('/' || file, '/') AS p, bytes, unnest(range(1, len(string_split('/' || file, '/')))) AS i FROM held),
        dirs AS (SELECT array_to_string(p[:i], '/') AS dir, CAST(sum(bytes) AS BIGINT) AS bytes FROM up GROUP BY 1)
        SELECT dir, bytes FROM dirs UNION ALL SELECT DISTINCT '/' || service || '/none', 0 FROM symbols""",
)
def directory_sizes(spark, path):
    """Bytes below every directory of an inventory of files, and of directories that hold none."""
    symbols = v.symbols(spark, path)
    inventory = symbols.groupBy(F.concat(F.lit("/"), "file").alias("path")).agg(F.sum(F.col("line").cast("bigint")).alias("bytes"))
    parts = F.split("path", "/")
    above = inventory.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir"))
    empty = symbols.select(F.concat(F.lit("/"), "service", F.lit("/none")).alias("dir"))
    return readers.directory_bytes(inventory, above.unionByName(empty))
