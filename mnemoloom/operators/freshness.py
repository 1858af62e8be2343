"""How far an index has fallen behind the code, and which files it has not seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordering import top_per

NAMEABLE_COMMITS = 40


def unseen_files(commits: DataFrame, built: DataFrame, uncommitted: DataFrame | None = None) -> DataFrame:
    """(service, commit, file) of code files changed after each service's index was built.

    `commits` is (service, commit, at, file), `built` (service, built_at); uncommitted
    work (service, file) has a null commit. Prose and generated output do not count.
    """
    later = commits.join(built, "service").filter(F.col("at") > F.col("built_at"))
    out = later.select("service", "commit", "file")
    if uncommitted is not None:
        known = uncommitted.join(built.select("service"), "service", "left_semi")
        commit = F.lit(None).cast(commits.schema["commit"].dataType)
        out = out.unionByName(known.select("service", commit.alias("commit"), "file"))
    return out.filter(tx.is_fresh_code("file"))


def staleness(unseen: DataFrame) -> DataFrame:
    """(service, commits, files, uncommitted) of services that are behind."""
    return unseen.groupBy("service").agg(
        F.countDistinct("commit").alias("commits"), F.countDistinct("file").alias("files"),
        F.countDistinct(F.when(F.col("commit").isNull(), F.col("file"))).alias("uncommitted"),
    )


def project_staleness(services: DataFrame, unseen: DataFrame) -> DataFrame:
    """(stale, commits, behind): the project as a whole. `services` (service) are the indexed ones."""
    per = services.join(staleness(unseen), "service", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    return per.agg(
        (F.count_if(F.col("commits") > 0) > 0).alias("stale"), F.coalesce(F.sum("commits"), F.lit(0)).alias("commits"),
        F.array_sort(F.collect_list(F.when(F.col("commits") > 0, F.col("service")))).alias("behind"),
    )


def named_files(unseen: DataFrame, limit: int = 40) -> DataFrame:
    """(service, file, rank): the first files of each service its index has not seen."""
    return top_per(unseen.select("service", "file").distinct(), ["service"], [F.col("file")], limit)


def is_current(built: Column | str, head: Column | str) -> Column:
    """Whether two commit ids name one commit (either may be short); null where one is unknown."""
    b, h = (F.col(c) if isinstance(c, str) else c for c in (built, head))
    return F.when(b.isNotNull() & h.isNotNull(), h.startswith(b) | b.startswith(h))


def changed_code(repos: DataFrame, unseen: DataFrame, file_limit: int = 5) -> DataFrame:
    """(service, commits, total, files): what to tell a session about each repository behind its code.

    `repos` is (service, built, head, behind). Current ones and ones with nothing new say
    nothing; past forty commits naming files stops being useful.
    """
    moved = repos.filter(~F.coalesce(is_current("built", "head"), F.lit(False)) & ~F.col("behind").eqNullSafe(F.lit(0)))
    far = F.coalesce(F.col("behind") > NAMEABLE_COMMITS, F.lit(False))
    near = moved.filter(~far).select("service")
    listed = unseen.join(near, "service", "left_semi")
    total = listed.groupBy("service").agg(F.countDistinct("file").alias("total"))
    shown = named_files(listed, file_limit).groupBy("service").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "file"))), lambda s: s["file"]).alias("files")
    )
    out = moved.join(total, "service", "left").join(shown, "service", "left")
    return out.filter(far | (F.col("total") > 0)).select(
        "service", F.col("behind").alias("commits"), F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files"),
    )


def sentences(changed: DataFrame) -> DataFrame:
    """(service, line): the same, in words."""
    far = F.format_string(
        "- %s: index older than the tree by %s commits; needs a rebuild",
        F.col("service"), F.coalesce(F.col("commits").cast("string"), F.lit("?")),
    )
    more = F.when(F.col("total") > F.size("files"), F.concat(F.lit(" + "), (F.col("total") - F.size("files")).cast("string"))).otherwise("")
    near = F.concat(
        F.lit("- "), "service", F.lit(": changed since the index was built ("), F.col("total").cast("string"),
        F.lit("): "), F.array_join("files", ", "), more,
    )
    return changed.select("service", F.when(F.col("total") == 0, far).otherwise(near).alias("line"))
