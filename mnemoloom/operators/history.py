"""Change history: churn, co-change, fan-in, coverage, and the risk ranking over them.

`commits` is (commit, at, author, file), one row per file a commit touched, merges
left out; `at` is in epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stored
from .ordering import top_per

FLOOR = 0.15


def since(commits: DataFrame, now: int, days: int = 365) -> DataFrame:
    return commits.filter(F.col("at") >= F.lit(now - days * 86400))


def churn(commits: DataFrame, approximate: bool = False) -> DataFrame:
    """(file, commits, authors, last). Author counts are exact unless asked otherwise."""
    authors = F.approx_count_distinct("author") if approximate else F.countDistinct("author")
    return commits.groupBy("file").agg(
        F.countDistinct("commit").alias("commits"), authors.alias("authors"), F.max("at").alias("last")
    )


def cochange(commits: DataFrame, max_files: int = 40) -> DataFrame:
    """(a, b, together): files changed by the same commit, a < b.

    A commit touching more than `max_files` says nothing about coupling. Such a commit
    is recognised by its first `max_files + 1` files, which is also all that is ever
    shipped of it, so a commit touching everything stays small. The pairs of a
    commit are counted map-side before they are shuffled.
    """
    touched = commits.select("commit", "file").distinct()
    first = top_per(touched, ["commit"], [F.col("file")], max_files + 1)
    files = (
        first.groupBy("commit")
        .agg(F.array_sort(F.collect_list("file")).alias("_files"))
        .filter(F.size("_files").between(2, max_files))
    )
    later = lambda a, i: F.transform(
        F.slice("_files", i + 2, F.size("_files")), lambda b: F.struct(a.alias("a"), b.alias("b"))
    )
    pairs = F.flatten(F.transform("_files", later))
    return files.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("together"))


def coupling(pairs: DataFrame, at_least: int = 3, limit: int = 8, keep: Column | None = None) -> DataFrame:
    """File pairs that keep changing together although they live in different directories.

    `keep` is a condition over `a` and `b`; by default both have to be code.
    """
    wanted = keep if keep is not None else tx.is_survey_code("a") & tx.is_survey_code("b")
    apart = tx.dirname("a") != tx.dirname("b")
    return (
        pairs.filter((F.col("together") >= at_least) & apart & wanted)
        .orderBy(F.col("together").desc(), "a", "b")
        .limit(limit)
    )


def _file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_file, to_file) of every link between two files, each once."""
    placed = symbols.filter(F.coalesce("file", F.lit("")) != "").select("node_id", "file")
    src = placed.select(F.col("node_id").alias("src"), F.col("file").alias("from_file"))
    dst = placed.select(F.col("node_id").alias("dst"), F.col("file").alias("to_file"))
    return edges.join(src, "src").join(dst, "dst").select("from_file", "to_file").distinct()


def _fans(between: DataFrame) -> DataFrame:
    return between.filter("from_file <> to_file").groupBy(F.col("to_file").alias("file")).agg(F.count(F.lit(1)).alias("fan"))


def _covered(between: DataFrame) -> DataFrame:
    reached = between.filter(tx.is_test_file("from_file") & ~tx.is_test_file("to_file"))
    return reached.select(F.col("to_file").alias("file")).distinct()


def fan_in(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, fan): how many other files call into each file."""
    return _fans(_file_edges(edges, symbols))


def tested_files(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files that are no tests themselves and that some test file calls into."""
    return _covered(_file_edges(edges, symbols))


def risk(
    commits: DataFrame,
    edges: DataFrame | None,
    symbols: DataFrame | None,
    existing: DataFrame | None = None,
    now: int | None = None,
    code_only: bool = True,
) -> DataFrame:
    """Every rankable file with its risk and the reasons for it.

    (file, commits, authors, fan, tested, risk, why, last_days). Maxima are taken over
    all files, before tests, prose and deleted files are left out.
    """
    # One pass over the history; the maxima and the authors come from the table per file.
    files = stored(
        commits.groupBy("file").agg(
            F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"), F.max("at").alias("last"),
            F.min("author").alias("_author"), F.max("author").alias("_other"),
        )
    )
    solo = files.agg(F.min("_author").eqNullSafe(F.max("_other")).alias("s")).scalar()
    max_commits = files.agg(F.greatest(F.max("commits"), F.lit(1)).alias("m")).scalar()
    out = files
    if edges is not None and symbols is not None:
        between = stored(_file_edges(edges, symbols))
        fans = _fans(between)
        max_fan = fans.agg(F.greatest(F.coalesce(F.max("fan"), F.lit(1)), F.lit(1)).alias("m")).scalar()
        covered = _covered(between).withColumn("tested", F.lit(True))
        out = out.join(fans, "file", "left").join(covered, "file", "left")
    else:
        max_fan = F.lit(1)
        out = out.withColumn("fan", F.lit(0)).withColumn("tested", F.lit(False))
    out = out.filter(~tx.is_test_file("file"))
    if code_only and symbols is not None:
        # What the index parsed is what this project calls code.
        out = out.join(symbols.select("file").distinct(), "file", "left_semi")
    elif code_only:
        out = out.filter(tx.is_survey_code("file"))
    if existing is not None:
        out = out.join(existing.select("file").distinct(), "file", "left_semi")
    out = (
        out.withColumn("fan", F.coalesce("fan", F.lit(0)))
        .withColumn("tested", F.coalesce("tested", F.lit(False)))
        .withColumn("_mc", max_commits).withColumn("_mf", max_fan).withColumn("_solo", solo)
    )
    busy = F.col("commits") >= F.greatest(F.lit(3.0), F.col("_mc") * 0.5)
    wide = F.col("fan") >= F.greatest(F.lit(2.0), F.col("_mf") * 0.5)
    why = F.array_compact(
        F.array(
            F.when(busy, F.concat(F.col("commits").cast("string"), F.lit(" commits"))),
            F.when(wide, F.concat(F.col("fan").cast("string"), F.lit(" dependent file(s)"))),
            F.when(~F.col("tested"), F.lit("no test reaches it")),
            F.when(
                (F.col("authors") == 1) & ~F.col("_solo"),
                F.concat(F.lit("one author ("), F.col("_author").cast("string"), F.lit(")")),
            ),
        )
    )
    last_days = tx.age_days("last", F.lit(now)) if now is not None else F.lit(None).cast("bigint")
    return out.select(
        "file", "commits", "authors", "fan", "tested",
        ((F.col("commits") / F.col("_mc") + FLOOR) * (F.col("fan") / F.col("_mf") + FLOOR)).alias("risk"),
        why.alias("why"), last_days.alias("last_days"),
    )


def riskiest(ranked: DataFrame, limit: int = 12) -> DataFrame:
    return ranked.orderBy(F.col("risk").desc(), F.col("commits").desc(), "file").limit(limit)


def safest(ranked: DataFrame, show: int = 3) -> DataFrame:
    """Active files tests already reach, least risky first: where to make a first change."""
    active = ranked.filter("tested and commits >= 2")
    return active.orderBy("risk", "commits", F.col("file").desc()).limit(show)
