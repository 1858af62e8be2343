"""The question-answering surface as plain functions over stored tables.

A `Store` is a folder of parquet tables named as in `sources.schemas`. Reading functions
return DataFrames; writing ones append to, or publish, a table. There is no server: a
caller is any Spark program.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import collide, evidence, explore, extract, history, memory, recall, symbols, tasks, trace, traversal, usage, verify
from .session import tune
from .sources import schemas, snapshots


# Tables that are asked for one repository at a time lie apart by it.
PARTITIONS = {"symbols": "repo", "edges": "repo"}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = tune(spark), root.rstrip("/")

    # Tables ---------------------------------------------------------------
    def read(self, name: str) -> DataFrame:
        """The current snapshot of a table, or an empty one of its schema."""
        fs, path_of = snapshots._fs(self.spark, self.root)
        if not fs.exists(path_of(f"{self.root}/{name}")):
            return self.spark.createDataFrame([], getattr(schemas, name.upper()))
        return snapshots.current(self.spark, f"{self.root}/{name}")

    def publish(self, name: str, df: DataFrame) -> int:
        """Make `df` the table: readers see the old snapshot until the new one is complete."""
        return snapshots.publish(df, f"{self.root}/{name}", partition_by=PARTITIONS.get(name))

    def update(self, name: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """Publish what `change` makes of the table. If another writer comes first, its table is what is changed."""
        empty = lambda df: self.spark.createDataFrame([], getattr(schemas, name.upper())) if df is None else df
        return snapshots.update(self.spark, f"{self.root}/{name}", lambda df: change(empty(df)), PARTITIONS.get(name))

    # Memory ---------------------------------------------------------------
    def memory_recall(self, query: str, vec: list[float] | None = None, limit: int = 8, budget: int = 6000, include_raw: bool = False, include_superseded: bool = False) -> DataFrame:
        """(position, key, line) of what one query brings back."""
        columns, row = "qid int, text string", (0, query)
        if vec is not None:
            columns, row = columns + ", embedding array<float>", (0, query, vec)
        facts, scenarios = self.read("facts"), self.read("scenarios")
        turns = self.read("turns") if include_raw else None
        asked = self.spark.createDataFrame([row], columns)
        found = recall.recall(asked, facts, scenarios, turns, limit, budget, include_superseded=include_superseded)
        keys = found.select(F.posexplode("selected").alias("position", "key"))
        return recall.lines(facts, scenarios, turns).join(keys, "key").select("position", "key", "line").orderBy("position")

    def memory_save_fact(self, new: DataFrame, paths: DataFrame) -> None:
        self.update("facts", lambda facts: verify.save_facts(facts, new, paths))

    def memory_supersede(self, new_id: int, old_ids: list[int]) -> None:
        old = self.spark.createDataFrame([(i,) for i in old_ids], "id bigint")
        self.update("facts", lambda facts: memory.supersede(facts, new_id, old))

    def memory_log(self, turns: DataFrame) -> None:
        self.update("turns", lambda have: have.unionByName(memory.capture(turns), allowMissingColumns=True))

    def memory_context_write(self, writes: DataFrame) -> None:
        """Upsert scenarios (path, content, summary); a path written again goes up one version."""

        def written(have: DataFrame) -> DataFrame:
            fresh = writes.join(have.select("path", F.col("version").alias("_v")), "path", "left")
            fresh = fresh.withColumn("version", F.coalesce(F.col("_v") + 1, F.lit(1))).drop("_v").withColumn("updated_at", F.current_timestamp())
            return have.join(writes.select("path"), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)

        self.update("scenarios", written)

    def memory_context_read(self, path: str) -> DataFrame:
        return self.read("scenarios").filter(F.col("path") == path)

    def memory_context_list(self, prefix: str = "") -> DataFrame:
        return memory.list_prefix(self.read("scenarios"), prefix).select("path", "summary", F.to_date("updated_at").alias("updated"))

    def memory_verify(self, paths: DataFrame) -> None:
        self.update("facts", lambda facts: verify.reverify(facts, paths))

    def memory_prune(self, now: str, days: int = 30, max_rows: int = 5000) -> None:
        self.update("turns", lambda turns: memory.prune(turns, F.lit(now).cast("timestamp"), days, max_rows))

    def stats(self) -> DataFrame:
        return usage.report(self.read("usage"))

    # Tasks ----------------------------------------------------------------
    def task_list(self, state: str = "open", repo: str | None = None) -> DataFrame:
        return tasks.listing(self.read("tasks"), state, repo)

    def task_resume(self, task_id: int) -> DataFrame:
        one = self.read("tasks").filter(F.col("id") == task_id)
        return tasks.resume(one, self.read("task_events").filter(F.col("task_id") == task_id), self.read("facts"))

    def task_note(self, events: DataFrame) -> None:
        """Append events (task_id, at, kind, detail); tasks follow their latest event."""
        self.update("task_events", lambda log: tasks.add_event(log, events))
        self.update("tasks", lambda have: tasks.touched(have, self.read("task_events")))

    # Code -----------------------------------------------------------------
    def code_context(self, repo: str, task: str, source_lines: DataFrame, vec: list[float] | None = None, limit: int = 5, lines: int = 14, expander: Callable | None = None, reranker: Callable | None = None) -> DataFrame:
        """(node_id, header, text, chars) of the symbols a task is about."""
        nodes = self.read("symbols").filter(F.col("repo") == repo)
        links = self.read("edges").filter(F.col("repo") == repo)
        found = symbols.select(nodes, links, task, min(max(limit, 1), 15), vec, expander, reranker)
        ids = found.select("node_id")
        near = links.join(ids, links["src"] == ids["node_id"], "left_semi").union(links.join(ids, links["dst"] == ids["node_id"], "left_semi"))
        judged = evidence.edge_verdicts(near.select("src", "dst", "file", "line").distinct(), nodes, source_lines)
        return evidence.packet(found, nodes, evidence.verified_edges(judged), source_lines, lines)

    def graph_impact(self, repo: str, ranges: DataFrame, limit: int = 20) -> DataFrame:
        nodes, links = (self.read(t).filter(F.col("repo") == repo) for t in ("symbols", "edges"))
        return explore.diff_impact(ranges, nodes, links, limit)

    def graph_path(self, repo: str, from_id: str, to_id: str) -> dict:
        nodes, links = (self.read(t).filter(F.col("repo") == repo) for t in ("symbols", "edges"))
        return traversal.shortest_path(links, nodes, from_id, to_id)

    def survey_repo(self, repo: str, commits: DataFrame, now: int, days: int = 365, limit: int = 12) -> DataFrame:
        nodes, links = (self.read(t).filter(F.col("repo") == repo) for t in ("symbols", "edges"))
        return history.riskiest(history.risk(history.since(commits, now, days), links, nodes, now=now), limit)

    def stream_collisions(self, repo: str, ranges: DataFrame) -> DataFrame:
        nodes, links = (self.read(t).filter(F.col("repo") == repo) for t in ("symbols", "edges"))
        return collide.Streams.of_masks(collide.stream_masks(ranges), nodes).compare(links)

    # Documents ------------------------------------------------------------
    def trace_stories(self, files: DataFrame, paths: DataFrame, sprint: DataFrame | None = None) -> DataFrame:
        return trace.summary(trace.assess(trace.specs(files), paths, sprint))

    def run_check(self, lines: DataFrame, runs: DataFrame, max_failures: int = 25) -> DataFrame:
        return extract.rendered(lines, runs, min(max(max_failures, 1), 200))

    def digest(self, texts: DataFrame, summarise: Callable[[str], str]) -> DataFrame:
        return extract.digest(texts, summarise)
