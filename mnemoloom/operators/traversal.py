"""Breadth-first questions over the edge table: neighbourhood, reverse impact, shortest path.

Each hop is one join of the frontier with the edges, a distinct, and an anti-join
with what was seen, materialised so that lineage does not grow with depth. Only a
frontier is joined, never the whole visited set with the edges. Where a cap or a
tie has to choose, smaller ids come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut

def _steps(edges: DataFrame, direction: str, carry: list[str]) -> DataFrame:
    """Edges as (at, to, back, *carry): `forward` along calls, `backward` to callers, `both`."""
    extra = [F.col(c) for c in carry]
    forward = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(False).alias("back"), *extra)
    backward = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(True).alias("back"), *extra)
    if direction == "forward":
        return forward
    return backward if direction == "backward" else forward.unionByName(backward)


def _bfs(
    edges: DataFrame,
    start: DataFrame,
    direction: str,
    depth: int,
    reduce: dict[str, Callable[[], Column]],
    allowed: DataFrame | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, bool]:
    """Visit level by level. `start` is (node_id, distance, *state); `reduce` folds the state per new node.

    Returns (visited, capped). `reduce` sees the step's
    columns and the frontier's state with a leading underscore.
    """
    state = [c for c in start.columns if c not in ("node_id", "distance")]
    carry = [c for c in ("via_contract",) if c in edges.columns]
    steps = _steps(edges, direction, carry)
    visited = cut(start)
    rows = total = visited.count()
    frontier, capped = visited, False
    for hop in range(1, depth + 1):
        here = frontier.select(F.col("node_id").alias("at"), *[F.col(c).alias(f"_{c}") for c in state])
        reached = (
            steps.join(here, "at")
            .groupBy(F.col("to").alias("node_id"))
            .agg(*[fold().alias(c) for c, fold in reduce.items()], F.count(F.lit(1)).alias("_visits"))
            .join(visited.select("node_id"), "node_id", "left_anti")
        )
        if allowed is not None:
            reached = reached.join(allowed, "node_id", "left_semi")
        fresh = cut(reached.select("node_id", F.lit(hop).alias("distance"), *state))
        rows = fresh.count()
        if limit is not None and total + rows > limit:
            capped = True
            fresh = cut(fresh.orderBy("node_id").limit(max(limit - total, 0)))
            rows = fresh.count()
        if rows == 0:
            break
        total += rows
        # Levels are materialised one by one, so their union costs nothing to carry along.
        visited = visited.unionByName(fresh)
        frontier = fresh
    return visited, capped


def _not_files(symbols: DataFrame) -> DataFrame:
    return symbols.filter(~tx.is_file_node("name", "file")).select("node_id")


def _start(symbols: DataFrame, node_id, **state: Column) -> DataFrame:
    extra = [value.alias(name) for name, value in state.items()]
    return symbols.filter(F.col("node_id") == F.lit(node_id)).select("node_id", F.lit(0).alias("distance"), *extra)


def neighbourhood(
    edges: DataFrame, symbols: DataFrame, node_id, depth: int = 1, limit: int | None = 60
) -> tuple[DataFrame, DataFrame, int]:
    """Symbols within `depth` calls in either direction, the links among the hops, and how many
    edge visits the cap turned away.

    Returns (nodes(node_id, distance), links(source, target), truncated).
    """
    nodes, capped = _bfs(
        edges, _start(symbols, node_id), "both", min(depth, 3), {}, _not_files(symbols), limit
    )
    inside = nodes.select("node_id", "distance")
    last = min(depth, 3) - 1
    expanded = inside.filter(F.col("distance") <= last)
    touching = _steps(edges, "both", []).join(expanded.select(F.col("node_id").alias("at")), "at")
    kept = touching.join(inside.select(F.col("node_id").alias("to")), "to", "left_semi")
    links = kept.select(
        F.when(F.col("back"), F.col("to")).otherwise(F.col("at")).alias("source"),
        F.when(F.col("back"), F.col("at")).otherwise(F.col("to")).alias("target"),
    ).distinct()
    truncated = 0
    if capped:
        outside = touching.join(inside.select(F.col("node_id").alias("to")), "to", "left_anti")
        truncated = outside.join(_not_files(symbols).withColumnRenamed("node_id", "to"), "to", "left_semi").count()
    return inside, links, truncated


def impact(
    edges: DataFrame, symbols: DataFrame, node_id, depth: int = 3, limit: int | None = 200
) -> tuple[DataFrame, bool]:
    """Everything that could feel a change: (node_id, distance, via_contract), and whether the cap cut any.

    `via_contract` is sticky: once a path leaves a service, everything past it is inferred.
    """
    if "via_contract" not in edges.columns:
        edges = edges.withColumn("via_contract", F.lit(False))
    sticky = {"inferred": lambda: F.bool_and(F.col("via_contract") | F.col("_inferred"))}
    start = _start(symbols, node_id, inferred=F.lit(False))
    reached, capped = _bfs(edges, start, "backward", depth, sticky, _not_files(symbols), limit)
    out = reached.filter(F.col("distance") > 0).withColumnRenamed("inferred", "via_contract")
    return out, capped


def impact_rows(reached: DataFrame, symbols: DataFrame, top: int = 40) -> DataFrame:
    """(node_id, distance, via_contract, name) of the nearest symbols of an impact answer, by distance and then name."""
    named = reached.join(symbols.select("node_id", "name"), "node_id")
    return named.select("node_id", "distance", "via_contract", "name").orderBy("distance", "name", "node_id").limit(top)


def impact_by_service(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """(service, symbols, files) of an impact answer."""
    placed = reached.join(symbols.select("node_id", "file", "service"), "node_id")
    return placed.groupBy(F.coalesce("service", F.lit("")).alias("service")).agg(
        F.count(F.lit(1)).alias("symbols"), F.countDistinct(F.nullif("file", F.lit(""))).alias("files")
    )


CAME = "came"


def _level(steps: DataFrame, frontier: DataFrame, seen: DataFrame, nodes: DataFrame) -> DataFrame:
    """The next level of a search: nodes that a step leads to and that were not seen, with the smallest way they were come by."""
    here = frontier.select(F.col("node_id").alias("at"))
    reached = steps.join(here, "at").groupBy(F.col("to").alias("node_id")).agg(F.min(F.struct(F.col("at").alias("prev"), "back", "via_contract")).alias(CAME))
    return cut(reached.join(seen.select("node_id"), "node_id", "left_anti").join(nodes, "node_id", "left_semi"))


def _search(steps: DataFrame, symbols: DataFrame, from_id, to_id, max_hops: int) -> list[DataFrame] | None:
    """The levels of nodes on shortest ways, from the start to the target, each with the smallest way it was come by.

    The search runs from both ends, and the smaller frontier moves. Where they meet, the ways of
    the far half are spelled out forwards again, inside the levels that its search has seen.
    """
    against = steps.select(F.col("to").alias("at"), F.col("at").alias("to"), "back", "via_contract")
    nodes = symbols.select("node_id")
    key = symbols.schema["node_id"].dataType.simpleString()
    none = F.lit(None).cast(f"struct<prev:{key},back:boolean,via_contract:boolean>").alias(CAME)
    ends = [cut(nodes.filter(F.col("node_id") == F.lit(x)).distinct().select("node_id", none)) for x in (from_id, to_id)]
    if any(e.isEmpty() for e in ends):
        return None
    fore, aft = [ends[0]], [ends[1]]
    if from_id == to_id:
        return fore
    seen, sizes = [ends[0], ends[1]], [1, 1]
    for _ in range(max_hops):
        side = 0 if sizes[0] <= sizes[1] else 1
        mine, other = (fore, aft) if side == 0 else (aft, fore)
        fresh = _level(steps if side == 0 else against, mine[-1], seen[side], nodes)
        mine.append(fresh)
        seen[side] = seen[side].unionByName(fresh)
        # Complete levels on both sides that had not met before can only meet at their borders.
        both = fresh.join(other[-1].select("node_id", F.lit(True).alias("met")), "node_id", "left").agg(F.count("*"), F.count("met")).first()
        sizes[side] = both[0]
        if both[1]:
            break
        if both[0] == 0:
            return None
    else:
        return None
    middle = fore[-1].join(aft[-1].select("node_id"), "node_id", "left_semi")
    levels = [*fore[:-1], middle]
    for level in reversed(aft[:-1]):
        here = levels[-1].select(F.col("node_id").alias("at"))
        onward = steps.join(here, "at").join(level.select(F.col("node_id").alias("to")), "to", "left_semi")
        levels.append(cut(onward.groupBy(F.col("to").alias("node_id")).agg(F.min(F.struct(F.col("at").alias("prev"), "back", "via_contract")).alias(CAME))))
    return levels


def path_steps(edges: DataFrame, symbols: DataFrame, from_id, to_id, max_hops: int = 64, undirected: bool = True) -> DataFrame:
    """(step, node_id, via_contract, reversed, directed) along the shortest way, calls first, else (unless not `undirected`)
    ignoring direction; no rows where there is none.

    Equally short ways are told apart, from the target back, by the smallest predecessor, then a
    call before its reverse and a call before a contract. The way back is one join per hop of a single row, in one job.
    """
    if "via_contract" not in edges.columns:
        edges = edges.withColumn("via_contract", F.lit(False))
    key = symbols.schema["node_id"].dataType.simpleString()
    shape = f"struct<node_id:{key},via_contract:boolean,reversed:boolean>"
    for directed in (True, False) if undirected else (True,):
        levels = _search(_steps(edges, "forward" if directed else "both", ["via_contract"]), symbols, from_id, to_id, max_hops)
        if levels is None:
            continue
        step = F.struct(
            F.col("node_id"), F.coalesce(F.col(f"{CAME}.via_contract"), F.lit(False)).alias("via_contract"), F.coalesce(F.col(f"{CAME}.back"), F.lit(False)).alias("reversed")
        )
        walk = levels[-1].filter(F.col("node_id") == F.lit(to_id)).select(F.array(step).cast(f"array<{shape}>").alias("way"), F.col(f"{CAME}.prev").alias("prev"))
        for level in reversed(levels[:-1]):
            before = level.select("node_id", step.cast(shape).alias("step"), F.col(f"{CAME}.prev").alias("earlier"))
            joined = before.join(F.broadcast(walk), before["node_id"] == walk["prev"])  # one row
            walk = joined.select(F.concat(F.array("step"), "way").alias("way"), F.col("earlier").alias("prev"))
        return walk.select(F.posexplode("way").alias("step", "_s")).select("step", "_s.*", F.lit(directed).alias("directed"))
    spark = symbols.sparkSession
    return spark.createDataFrame([], f"step int, node_id {key}, via_contract boolean, reversed boolean, directed boolean")


def shortest_path(edges: DataFrame, symbols: DataFrame, from_id, to_id, max_hops: int = 64, undirected: bool = True) -> dict:
    """The answer of `path_steps` (a row per hop) as one value: found, directed, hops, crossings, steps of (node_id, via_contract, reversed)."""
    rows = sorted(path_steps(edges, symbols, from_id, to_id, max_hops, undirected).collect(), key=lambda r: r.step)
    if not rows:
        return {"found": False, "directed": None, "hops": None, "crossings": None, "steps": []}
    steps = [(r.node_id, r.via_contract, r.reversed) for r in rows]
    return {"found": True, "directed": rows[0].directed, "hops": len(steps) - 1, "crossings": sum(s[1] for s in steps), "steps": steps}


def merge_order(names: DataFrame, before: DataFrame) -> DataFrame:
    """(name, layer): Kahn's order by layers; a name with no layer belongs to a cycle.

    `before` is (name, needs): `name` has to come after `needs`. Names inside a
    layer are ordered alphabetically by whoever reads them.
    """
    pending = cut(before.select("name", "needs").distinct())
    state = cut(names.select("name").distinct().withColumn("layer", F.lit(None).cast("int")))
    layer = 0
    while True:
        waiting = state.filter("layer is null").select(F.col("name").alias("needs"))
        blocked = pending.join(waiting, "needs", "left_semi").select("name").distinct()
        blocked = blocked.withColumn("_blocked", F.lit(True))
        # One materialised table per round: names with the layers decided so far.
        decided = F.when(F.col("layer").isNull() & F.col("_blocked").isNull(), F.lit(layer)).otherwise(F.col("layer"))
        state = cut(state.join(blocked, "name", "left").select("name", decided.alias("layer")))
        if state.filter(F.col("layer") == layer).isEmpty():
            return state
        layer += 1
