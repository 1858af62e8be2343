"""Decision tables as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


# What the wording of a task calls for, first match first: the tier, the patterns that must all be met, the most words
# the task may have, and the reason given.
SIZING_RULES = (
    ("hardest", (fixed.SIZING_LONG_RUN, fixed.SIZING_DESIGNING), None, "runs for long on its own and has to weigh options"),
    ("deep", (fixed.SIZING_DESIGNING,), None, "has to weigh options"),
    ("light", (fixed.SIZING_EXPLAINING,), 20, "asks about code, changes none"),
    ("light", (fixed.SIZING_MECHANICAL,), 20, "short and mechanical"),
)


def task_tier(task: Column | str) -> Column:
    """struct(tier, why): the tier a task's own words ask for; unsure means the default."""
    text = F.lower(F.coalesce(F.col(task) if isinstance(task, str) else task, F.lit("")))
    length = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    named = lambda tier, why: F.struct(F.lit(tier).alias("tier"), F.lit(why).alias("why"))
    out = named(fixed.DEFAULT_TIER, "no sign that less would do")
    for tier, patterns, most, why in reversed(SIZING_RULES):
        met = F.lit(True) if most is None else length <= most
        for pattern in patterns:
            met = met & text.rlike(pattern)
        out = F.when(met, named(tier, why)).otherwise(out)
    return out


def read_only(tier: Column) -> Column:
    """A session that can change nothing does not need the expensive tiers."""
    return F.when(tier.isin("hardest", "deep"), "standard").otherwise(tier)


def sized(tasks: DataFrame, task: str = "task", reply: str | None = None, permission: str | None = None) -> DataFrame:
    """Tasks with (tier, why, by). A classifier's reply decides where it names a tier, else the rules do.

    `reply` holds the classifier's answer, `permission` the session's mode; both are optional columns.
    """
    rule = task_tier(task)
    out = tasks.withColumn("_rule", rule)
    tier, why, by = F.col("_rule.tier"), F.col("_rule.why"), F.lit("rules")
    if reply is not None:
        line = F.coalesce(
            F.get(F.filter(F.split(F.trim(F.coalesce(F.col(reply), F.lit(""))), r"\r?\n"), lambda s: s != ""), F.lit(0)), F.lit("")
        )
        named = F.regexp_replace(F.lower(F.trim(F.split(line, r"\|")[0])), "[^a-z]", "")
        said = F.regexp_replace(F.trim(F.regexp_replace(line, r"^[^|]*\|?", "")), "^[\"']|[\"']$", "")
        valid = named.isin(fixed.TIERS)
        tier = F.when(valid, named).otherwise(tier)
        why = F.when(valid, F.coalesce(F.nullif(said, F.lit("")), F.lit("picked by the classifier"))).otherwise(why)
        by = F.when(valid, "the local model").otherwise("rules")
    if permission is not None:
        reading = F.coalesce(F.col(permission) == "read", F.lit(False))
        tier = F.when(reading, read_only(F.col("_rule.tier"))).otherwise(tier)
        why = F.when(reading, "the session may only read").otherwise(why)
        by = F.when(reading, "rules").otherwise(by)
    return out.withColumn("tier", tier).withColumn("why", why).withColumn("by", by).drop("_rule")


def tier_models(defaults: dict[str, str], saved: dict | None) -> dict[str, str]:
    """Which model each tier runs: saved names over the defaults, unknown tiers and blanks ignored."""
    named = (saved or {}).get("tiers", {}) if isinstance(saved, dict) else {}
    return {
        tier: named[tier].strip() if isinstance(named.get(tier), str) and named[tier].strip() else model
        for tier, model in defaults.items()
    }


def routing_enabled(env: str | None, saved: dict | None) -> bool:
    """The environment wins; otherwise off unless saved as on."""
    if env:
        return env.lower() != "off"
    return bool(isinstance(saved, dict) and saved.get("enabled") is True)


def _sentence(template: str, parts: dict[str, Column]) -> Column:
    """A sentence with its gaps filled; what follows a part that is empty is trimmed."""
    pieces = [parts[p] if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{(\w+)\}", template)) if p]
    return F.trim(F.concat(*pieces))


def stream_verdict(max_age_days: int = 14, builds_only: bool = False) -> Column:
    """struct(action, why) for a work stream with columns exists, dirty, pinned, merged, untouched,
    evaluated, evaluated_at, age_days, build_bytes, unmerged_commits, base.

    With `builds_only` a removal becomes the freeing of build output, or nothing.
    """
    old = F.coalesce(F.col("age_days") >= max_age_days, F.lit(False))
    built = F.col("build_bytes") > 0
    met = {
        "gone": ~F.col("exists"), "dirty": F.col("dirty"), "pinned": F.col("pinned"), "empty": F.col("merged") & F.col("untouched"), "merged": F.col("merged"),
        "evaluated": F.col("evaluated"), "reclaimable": old & built, "old": old, "any": F.lit(True),
    }
    parts = {
        "base": F.col("base"), "day": F.substring(F.coalesce("evaluated_at", F.lit("")), 1, 10), "age": F.col("age_days").cast("string"),
        "unmerged": F.col("unmerged_commits").cast("string"),
    }
    verdict = lambda action, why: F.struct(F.lit(action).alias("action"), why.alias("why"))
    out = None
    for name, action, template in reversed(fixed.STREAM_RULES):
        why = _sentence(template, parts)
        told = verdict(action, why)
        if builds_only and action == "remove":
            told = F.when(built, verdict("builds", why)).otherwise(verdict("keep", F.lit(fixed.STREAM_NOTHING)))
        out = told if out is None else F.when(met[name], told).otherwise(out)
    return out


def dirty_streams(status: DataFrame, build_dir: str = fixed.BUILD_DIR) -> DataFrame:
    """(stream, dirty) from status lines (stream, line): untracked build output is not work at risk."""
    path = F.regexp_replace(F.substring("line", F.lit(4), F.length("line")), '^"|"$', "")
    at_risk = ~F.col("line").startswith("??") | ~F.split(path, "/")[0].rlike(build_dir)
    return status.filter("line <> ''").groupBy("stream").agg(F.bool_or(at_risk).alias("dirty"))


def detect_checks(files: DataFrame, configured: str = "checks") -> DataFrame:
    """(repo, position, name, command): the checks a project runs, from its marker files (repo, name, text).

    An explicit list in package.json wins, then its scripts, then the first ecosystem present.
    """
    # Only marker files are looked at, so a repository of any size is a handful of names.
    files = files.filter(F.col("name").isin("package.json", "Makefile", "makefile", *[m for m, _ in fixed.ECOSYSTEM_CHECKS]))
    pkg = files.filter("name = 'package.json'").groupBy("repo").agg(F.max("text").alias("_pkg"))
    names = files.groupBy("repo").agg(F.collect_set("name").alias("_names"))
    make = files.filter("name in ('Makefile', 'makefile')").groupBy("repo").agg(F.min_by("text", "name").alias("_make"))
    repos = names.join(pkg, "repo", "left").join(make, "repo", "left")

    def item(name: Column, command: Column) -> Column:
        return F.struct(name.alias("name"), command.alias("command"))

    empty = F.array().cast("array<struct<name:string,command:string>>")
    explicit = F.coalesce(
        F.from_json(F.get_json_object("_pkg", f"$.{configured}"), "array<struct<name:string,command:string>>"), empty
    )
    plain = F.coalesce(F.from_json(F.get_json_object("_pkg", f"$.{configured}"), "array<string>"), F.array().cast("array<string>"))
    explicit = F.filter(explicit, lambda c: c["command"].isNotNull())
    plain = F.transform(F.filter(plain, lambda c: c.isNotNull() & ~c.startswith("{")), lambda c: item(c, c))
    scripts = F.array_compact(
        F.array(*[
            F.when(F.get_json_object("_pkg", f"$.scripts.{s}").isNotNull(), item(F.lit(s), F.lit(f"npm run {s} --silent")))
            for s in fixed.SCRIPT_ORDER
        ])
    )
    found = F.when(F.size(explicit) > 0, explicit).when(F.size(plain) > 0, plain).when(F.size(scripts) > 0, scripts)
    for marker, checks in fixed.ECOSYSTEM_CHECKS:
        found = found.when(F.array_contains("_names", marker), F.array(*[item(F.lit(n), F.lit(c)) for n, c in checks]))
    targets = F.array_compact(
        F.array(*[F.when(F.col("_make").rlike(f"(?m)^{t}\\s*:"), item(F.lit(t), F.lit(f"make {t}"))) for t in fixed.MAKE_TARGETS])
    )
    found = found.when(F.size(targets) > 0, targets).otherwise(empty)
    return repos.select("repo", F.posexplode(found).alias("position", "_c")).select("repo", "position", "_c.name", "_c.command")


def menu(items: DataFrame, installed: DataFrame) -> DataFrame:
    """Items (group, position, id, label, needs, then) this project can run, `next` naming a follow-up that runs too.

    An item that needs nothing always runs. Groups left empty have no rows.
    """
    have = installed.select(F.col("name").alias("needs")).distinct().withColumn("_have", F.lit(True))
    runnable = items.join(have, "needs", "left").filter(F.col("needs").isNull() | F.col("_have")).drop("_have")
    follow = runnable.select(F.col("id").alias("then"), F.col("label").alias("next"))
    return runnable.join(follow, "then", "left").select("group", "position", "id", "label", "needs", "next")


def roles(menu_items: DataFrame, role_tasks: DataFrame) -> DataFrame:
    """The same items by role: (role, position, label) kept where the menu offers the label."""
    return role_tasks.join(menu_items.select("label").distinct(), "label", "left_semi")


def current_workflows(workflows: DataFrame) -> DataFrame:
    """Workflows that are not forwarding stubs."""
    return workflows.filter(~F.coalesce("description", F.lit("")).rlike(r"(?i)^deprecated\b"))
