"""What a project page and a session's opening context are put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import history, memory, tasks, trace
from .explore import project_of
from .freshness import is_current, named_files
from .ordering import top_per


def cards(projects: DataFrame, streams: DataFrame, open_tasks: DataFrame, indexed: DataFrame, checks: DataFrame) -> DataFrame:
    """(path, streams, tasks, symbols, checks) per registered project (path), zero where it has none.

    `streams` and `open_tasks` carry `repo`, `indexed` is (repo, symbols), `checks` (repo, name).
    Each side is counted before it is joined.
    """

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("repo").alias("path")).agg(F.count(F.lit(1)).alias(name))

    out = projects.select("path").distinct()
    out = out.join(tally(streams, "streams"), "path", "left")
    out = out.join(tally(open_tasks.filter("state = 'open'"), "tasks"), "path", "left")
    out = out.join(indexed.groupBy(F.col("repo").alias("path")).agg(F.sum("symbols").alias("symbols")), "path", "left")
    return out.join(tally(checks, "checks"), "path", "left").fillna(0, ["streams", "tasks", "symbols", "checks"])


def brief(projects: DataFrame, indexed: DataFrame, streams: DataFrame, open_tasks: DataFrame, shown: int = 3) -> DataFrame:
    """(path, symbols, current, streams, removable, open_tasks, newest) per registered project (path).

    `indexed` is (repo, symbols, built, head); `current` is null where a commit is not known. `streams` is (repo, action) with
    the verdicts of `rules.stream_verdict`, `newest` the (id, title) of the open tasks (repo, id, title, state, updated_at) touched last.
    """
    known = indexed.select(F.col("repo").alias("path"), "symbols", is_current("built", "head").alias("current"))
    kept = streams.groupBy(F.col("repo").alias("path")).agg(
        F.count(F.lit(1)).alias("streams"), F.count_if(F.col("action").isin("remove", "forget")).alias("removable")
    )
    waiting = open_tasks.filter("state = 'open'")
    counted = waiting.groupBy(F.col("repo").alias("path")).agg(F.count(F.lit(1)).alias("open_tasks"))
    last = top_per(waiting, ["repo"], [F.col("updated_at").desc(), F.col("id").desc()], shown).groupBy(F.col("repo").alias("path")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "title"))), lambda t: F.struct(t["id"].alias("id"), t["title"].alias("title"))).alias("newest")
    )
    out = projects.select("path").distinct()
    for side in (known, kept, counted, last):
        out = out.join(side, "path", "left")
    return out.fillna(0, ["symbols", "streams", "removable", "open_tasks"])


def sessions_of(sessions: DataFrame, root: str, streams: DataFrame) -> DataFrame:
    """Sessions (id, cwd, state, started) inside a project or in one of its streams, running ones first.

    A worktree lies beside its repository, so it is claimed by name; `streams` is (name, repo, path).
    """
    spark = sessions.sparkSession
    here = spark.createDataFrame([(root,)], "root string")

    def inside(df: DataFrame, column: str) -> DataFrame:
        placed = project_of(df.select(F.col(column).alias("dir")), here).filter("root is not null")
        return df.join(placed.select(F.col("dir").alias(column)), column, "left_semi")

    owned = inside(streams, "repo").select(F.col("path").alias("cwd"), F.col("name").alias("stream")).distinct()
    mine = inside(sessions, "cwd").join(owned, "cwd", "left")
    beside = sessions.join(owned, "cwd").join(mine.select("id"), "id", "left_anti")
    running = F.when(F.col("state") == "running", 0).otherwise(1)
    return mine.unionByName(beside).orderBy(running, F.col("started").desc(), "id")


def insight(specs: DataFrame, paths: DataFrame, commits: DataFrame, edges: DataFrame, symbols: DataFrame, now: int) -> dict[str, DataFrame]:
    """The parts of a project's insight view: story summary, riskiest eight files, five closest couples."""
    ranked = history.risk(commits, edges, symbols, now=now)
    return {
        "trace": trace.summary(trace.assess(specs, paths)),
        "risk": history.riskiest(ranked, 8),
        "coupling": history.coupling(history.cochange(commits)).limit(5),
    }


def context_lines(checks: DataFrame, open_tasks: DataFrame, stories: DataFrame, facts: DataFrame) -> DataFrame:
    """(section, position, line): what every flow should know before it starts, each list bounded.

    `stories` are assessed ones.
    """

    def part(section: int, rows: DataFrame, order: list[Column], line: Column, limit: int) -> DataFrame:
        # At most a few dozen rows, so numbering them in one window is no concern.
        numbered = rows.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(W.orderBy(*order)))
        return numbered.select(F.lit(section).alias("section"), "position", line.alias("line"))

    ready = stories.filter(F.col("state").rlike("(?i)ready|progress|backlog"))
    task = F.concat(F.lit("  - task "), F.col("id").cast("string"), F.lit(": "), "title")
    story = F.concat(F.lit("  - "), "id", F.lit(": "), "title", F.lit(" ["), "state", F.lit("]"))
    return (
        part(0, checks, [F.col("position")], F.col("command"), 50)
        .unionByName(part(1, tasks.listing(open_tasks, limit=5), [F.col("updated_at").desc(), F.col("id").desc()], task, 5))
        .unionByName(part(2, ready, [F.col("id")], story, 8))
        .unionByName(part(3, memory.recent(facts), [F.col("priority").desc(), F.col("id").desc()], F.concat(F.lit("  - "), F.substring("content", 1, 180)), 6))
    )


def drift_header(unseen: DataFrame, most: int = 24) -> DataFrame:
    """(total, line): the changed files an index has not seen, the first of them by name; no row when current."""
    names = named_files(unseen, 40).select(F.concat_ws("/", "service", "file").alias("name"))
    total = unseen.select("service", "file").distinct().agg(F.count(F.lit(1)).alias("total"))
    shown = names.orderBy("name").limit(most).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("_names"))
    lead = F.concat(
        F.lit("not in the index ("), F.col("total").cast("string"), F.lit(" changed files): "),
    )
    more = F.when(F.col("total") > most, F.concat(F.lit(" + "), (F.col("total") - most).cast("string"))).otherwise("")
    listed = shown.agg(F.first("_names")).scalar()
    return total.filter("total > 0").select("total", F.concat(lead, listed, more).alias("line"))
