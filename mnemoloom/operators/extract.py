"""What failed in a run's output, and how its checks went.

`lines` is (run, n, text) with consecutive `n` per run, optionally with `stream`
('stderr' or 'stdout'). Neighbouring lines are met by joining on the line number,
so one enormous run is as spread out as many small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..session import stored
from .ordering import top_per

MAX_FAILURES = 25


def flagged(lines: DataFrame) -> DataFrame:
    """Lines that are a failure or, failing that, a summary: adds `reason`."""
    reason = F.when(tx.is_failure("text"), "failure").when(tx.is_summary("text"), "summary")
    return lines.withColumn("reason", reason).filter("reason is not null")


def kept_lines(
    lines: DataFrame, max_failures: int = MAX_FAILURES, context: int = 2, by: list[str] | None = None,
    caps: DataFrame | None = None,
) -> DataFrame:
    """(run, n, text, reason) worth showing: failures up to the cap, what continues them, summaries.

    `caps` (keys, cap) lowers the cap per run. A failure past the cap can still show
    as the continuation of one before it.
    """
    keys = by or ["run"]
    marks = flagged(lines)
    failures = top_per(marks.filter("reason = 'failure'"), keys, [F.col("n")], max_failures, "_rank")
    if caps is not None:
        failures = failures.join(caps, keys, "left").filter(F.col("_rank") <= F.coalesce("cap", F.lit(max_failures))).drop("cap")
    failures = failures.drop("_rank")
    after = failures.select(*keys, F.explode(F.sequence(F.col("n") + 1, F.col("n") + context)).alias("n")).distinct()
    carries = lines.filter(F.col("text").rlike(fixed.CONTEXT_PATTERN) & (F.trim(F.regexp_replace("text", r"\s", "")) != ""))
    follow = carries.join(after, [*keys, "n"], "left_semi").withColumn("reason", F.lit("context"))
    order = F.when(F.col("reason") == "failure", 0).when(F.col("reason") == "summary", 1).otherwise(2)
    together = failures.unionByName(marks.filter("reason = 'summary'")).unionByName(follow)
    best = together.groupBy(*keys, "n").agg(F.min_by(F.struct("text", "reason"), order).alias("_r"))
    return best.select(*keys, "n", "_r.text", "_r.reason")


def failure_counts(lines: DataFrame, max_failures: int = MAX_FAILURES, by: list[str] | None = None) -> DataFrame:
    """(run, failures, truncated, recognised, total_lines)."""
    keys = by or ["run"]
    failed = tx.is_failure("text")
    n = F.count_if(failed)
    return lines.groupBy(*keys).agg(
        n.alias("failures"), F.greatest(n - max_failures, F.lit(0)).alias("truncated"),
        F.bool_or(failed | tx.is_summary("text")).alias("recognised"), F.count(F.lit(1)).alias("total_lines"),
    )


def check_lines(lines: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """Both streams of a run: stderr first, stdout with what is left of the cap. `lines` has `stream`."""
    err, out = lines.filter("stream = 'stderr'"), lines.filter("stream = 'stdout'")
    spent = failure_counts(err).select("run", F.greatest(F.lit(max_failures) - F.col("failures"), F.lit(0)).alias("cap"))
    first = kept_lines(err.drop("stream"), max_failures).withColumn("place", F.lit(0))
    second = kept_lines(out.drop("stream"), max_failures, caps=spent).withColumn("place", F.lit(1))
    return first.unionByName(second)


def tail(lines: DataFrame, last: int = 20) -> DataFrame:
    """The last nonblank lines of each run, for output no pattern recognises."""
    return top_per(lines.filter("text <> ''"), ["run"], [F.col("n").desc()], last, "_rank").drop("_rank")


def rendered(lines: DataFrame, runs: DataFrame, max_failures: int = MAX_FAILURES, last: int = 20) -> DataFrame:
    """(run, place, n, text): what a reader of each run gets. `runs` is (run, code).

    Kept lines; for a failing run nothing recognised, its tail.
    """
    counts = failure_counts(lines, max_failures).join(runs, "run")
    silent = counts.filter("not recognised and not (code = 0 and failures = 0)").select("run")
    shown = kept_lines(lines, max_failures).select("run", "n", "text")
    return shown.unionByName(tail(lines, last).join(silent, "run", "left_semi").select("run", "n", "text"))


def gate(results: DataFrame) -> DataFrame:
    """(repo, position, name, code) of the checks that ran: everything up to the first that failed."""
    first = results.filter("code <> 0").groupBy("repo").agg(F.min("position").alias("_stop"))
    return results.join(first, "repo", "left").filter(F.col("_stop").isNull() | (F.col("position") <= F.col("_stop"))).drop("_stop")


def gate_verdict(results: DataFrame) -> DataFrame:
    """(repo, passed, ran, total)."""
    total = results.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    ran = gate(results).groupBy("repo").agg(F.bool_and(F.col("code") == 0).alias("passed"), F.count(F.lit(1)).alias("ran"))
    return ran.join(total, "repo")


def digest_chunks(texts: DataFrame, key: str = "id", text: str = "content", size: int = 18000) -> DataFrame:
    """(key, chunk, content) of every text in pieces of `size` characters, whole texts covered."""
    count = F.ceil(F.length(text) / F.lit(size)).cast("int")
    pieces = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)),
    )
    return texts.select(key, F.posexplode(pieces).alias("chunk", "content"))


def digest(texts: DataFrame, summarise, key: str = "id", size: int = 18000, passes: int = 3) -> DataFrame:
    """Reduce each text chunk by chunk through `summarise` until it fits, at most `passes` times.

    `summarise` is an injected function from text to text; each chunk is its own row, so
    a long text is summarised by many tasks.
    """
    import pandas as pd

    shorten = F.pandas_udf(lambda s: pd.Series([summarise(x) for x in s]), "string")
    level = texts.select(key, F.col("content"))
    done = level.filter(F.lit(False))
    for _ in range(passes):
        done = done.unionByName(level.filter(F.length("content") <= size))
        chunks = digest_chunks(level.filter(F.length("content") > size), key, "content", size)
        # A text's chunks are put together again in one row, which was one row to begin with.
        level = stored(chunks.select(key, "chunk", shorten("content").alias("content")).groupBy(key).agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("chunk", "content"))), lambda c: c["content"]), "\n"
            ).alias("content")
        ))
    fits = done.unionByName(level.filter(F.length("content") <= size))
    return fits.select(key, shorten("content").alias("content")).unionByName(level.filter(F.length("content") > size))


def raw_tail(lines: DataFrame, last: int = 400) -> DataFrame:
    """The last raw lines of each session."""
    return top_per(lines, ["run"], [F.col("n").desc()], last, "_rank").drop("_rank")


