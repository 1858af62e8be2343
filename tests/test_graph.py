"""Graph operators on small graphs and against brute force on random ones."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from mnemoloom.operators import collide, evidence, explore, graph, history, spans, traversal

SYM = "node_id string, name string, label string, file string, line int, callable boolean, service string"
EDGE = "src string, dst string, file string, line int"


def random_graph(spark, seed, n=40, m=90):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(n)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)]
    syms = [(x, x, x + "()", f"s{i % 3}/f{i % 7}.js", i + 1, True, f"s{i % 3}") for i, x in enumerate(nodes)]
    return nodes, edges, spark.createDataFrame(syms, SYM), spark.createDataFrame(edges, "src string, dst string")


def walk(start, step, depth):
    seen, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        if seen[at] == depth:
            continue
        for to in step(at):
            if to not in seen:
                seen[to] = seen[at] + 1
                queue.append(to)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_traversals_match_brute_force(spark, seed):
    nodes, edges, syms, df = random_graph(spark, seed)
    out = lambda x: [b for a, b in edges if a == x]
    back = lambda x: [a for a, b in edges if b == x]
    got, links, cut = traversal.neighbourhood(df, syms, "n00", depth=2, limit=None)
    near = walk("n00", lambda x: out(x) + back(x), 2)
    assert {r.node_id: r.distance for r in got.collect()} == near and cut == 0
    core = {x for x, d in near.items() if d < 2}
    want = {(a, b) for a, b in edges if a in near and b in near and (a in core or b in core)}
    assert {(r.source, r.target) for r in links.collect()} == want
    reached, capped = traversal.impact(df, syms, "n00", depth=3, limit=None)
    assert {r.node_id: r.distance for r in reached.collect()} == {x: d for x, d in walk("n00", back, 3).items() if d} and not capped
    for to in nodes[1:4]:
        path = traversal.shortest_path(df, syms, "n00", to)
        directed = walk("n00", out, 99).get(to)
        any_way = walk("n00", lambda x: out(x) + back(x), 99).get(to)
        assert path["hops"] == (directed if directed is not None else any_way)
        assert path["directed"] == (None if any_way is None else directed is not None)
        for (a, _, _), (b, _, reverse) in zip(path["steps"], path["steps"][1:]):
            assert ((b, a) if reverse else (a, b)) in edges


def test_caps_are_reported(spark):
    edges = spark.createDataFrame([(f"c{i}", "hub") for i in range(9)] + [("c0", "hub")], "src string, dst string")
    syms = spark.createDataFrame([(x, x, x, "f.js", 1, True, "s") for x in ["hub"] + [f"c{i}" for i in range(9)]], SYM)
    got, capped = traversal.impact(edges, syms, "hub", limit=5)
    assert sorted(r.node_id for r in got.collect()) == ["c0", "c1", "c2", "c3"] and capped
    nodes, _, truncated = traversal.neighbourhood(edges, syms, "hub", limit=5)
    assert nodes.count() == 5 and truncated == 5
    assert not traversal.impact(edges, syms, "hub", limit=10)[1]
    assert {r.degree for r in graph.degree(edges).filter("node_id = 'hub'").collect()} == {10}


def test_files_are_not_reached_and_contracts_stick(spark):
    syms = spark.createDataFrame(
        [("f", "a.js", "a.js", "w/a.js", 1, False, "w"), ("a", "a", "a()", "w/a.js", 5, True, "w"), ("b", "b", "b()", "x/b.js", 5, True, "x"), ("c", "c", "c()", "x/b.js", 50, True, "x")],
        SYM,
    )
    edges = spark.createDataFrame([("f", "a", "w/a.js", 1), ("b", "c", "x/b.js", 9)], EDGE)
    contracts = spark.createDataFrame([("w/a.js", 7, "x/b.js", 6, "/p", "GET", "literal match")], "from_file string, from_line int, to_file string, to_line int, path string, method string, confidence string")
    joined = explore.with_contracts(edges, syms, contracts)
    got = {r.node_id: (r.distance, r.via_contract) for r in traversal.impact(joined, syms, "c")[0].collect()}
    assert got == {"b": (1, False), "a": (2, True)}
    assert traversal.shortest_path(joined, syms, "a", "c")["crossings"] == 1


@pytest.mark.parametrize("seed", range(3))
def test_interval_joins_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{i:03d}", f"n{i}", f"n{i}()", rng.choice("ab") + ".js", rng.randint(1, 400), True, "s") for i in range(150)]
    owned = []
    for f in ("a.js", "b.js"):
        here = sorted((r for r in rows if r[3] == f), key=lambda r: (r[4], r[0]))
        for r, nxt in zip(here, here[1:] + [None]):
            owned.append((r[0], f, r[4], nxt[4] - 1 if nxt else spans.OPEN_END))
    got = spans.symbol_spans(spark.createDataFrame(rows, SYM))
    assert sorted(map(tuple, got.collect())) == sorted(owned)
    hunks = [(s, rng.choice(["a.js", "b.js", "new.js"]), lo, lo + rng.choice([-1, 0, 3, 90])) for s in "xy" for lo in [rng.randint(1, 900) for _ in range(40)]]
    ranges = spark.createDataFrame(hunks, "stream string, file string, lo int, hi int")
    want = {(s, n, f) for s, f2, lo, hi in hunks for n, f, a, b in owned if f == f2 and hi >= a and lo <= b}
    assert {tuple(r) for r in spans.in_ranges(ranges, got, ["stream"]).collect()} == want
    points = [(f, x) for _, f, x, _ in hunks]
    held = {(f, x): next((n for n, g, a, b in owned if g == f and a <= x <= b), None) for f, x in points}
    answered = spans.enclosing(spark.createDataFrame(points, "file string, line int"), got).collect()
    assert len(answered) == len(points) and all(held[(r.file, r.line)] == r.node_id for r in answered)


def test_tree_folds_single_chains(spark):
    files = ["api/src/main/a.js", "api/src/main/b.js", "lib/x.js", "lib/deep/er/y.js", "top.js"]
    syms = spark.createDataFrame([(f"n{i}", f"n{i}", "", f, 1, True, "s") for i, f in enumerate(files)], SYM)
    rows = {r.path: (r.name, r.parent, r.symbols, r.children) for r in explore.tree_rows(syms).collect()}
    assert rows["api/src/main"] == ("api/src/main", "", 2, 2) and "api" not in rows and "api/src" not in rows
    assert rows["lib"] == ("lib", "", 2, 2) and rows["lib/deep/er"] == ("deep/er", "lib", 1, 1)
    assert rows[""] == ("", None, 5, 3) and rows["lib/deep/er/y.js"][:2] == ("y.js", "lib/deep/er")
    level = {r.path: r.has_more for r in explore.tree(syms, "lib", 1).collect()}
    assert level == {"lib": False, "lib/deep/er": True, "lib/x.js": True}
    assert explore.tree(syms, "nowhere").count() == 0


def test_edges_against_source(spark):
    source = {
        "run.js": ["import { open as openDb, close } from './db.js'", "", "function start() {", "  openDb()", "  close(1)", "  x.parse(2)", "}", "const save = 1", "save(3)", "new Promise((resolve) => {", "  resolve()", "})"],
        "db.js": ["function open() {}", "function close() {}", "function parse() {}", "function save() {}", "function resolve() {}", "function gone() {}"],
    }
    lines = spark.createDataFrame([(f, i + 1, t) for f, ls in source.items() for i, t in enumerate(ls)], "file string, line int, text string")
    names = ["open", "close", "parse", "save", "resolve", "gone"]
    syms = [("start", "start", "start()", "run.js", 3, True, "s"), ("file", "db.js", "db.js", "db.js", 1, False, "s")]
    syms = spark.createDataFrame(syms + [(n, n, n + "()", "db.js", i + 1, True, "s") for i, n in enumerate(names)], SYM)
    sites = [("open", 4), ("close", 99), ("parse", 6), ("save", 9), ("resolve", 11), ("gone", 5), ("file", 1)]
    edges = spark.createDataFrame([("start", n, "run.js", at) for n, at in sites], EDGE)
    judged = evidence.edge_verdicts(edges, syms, lines)
    assert {r.dst: r.verdict for r in judged.collect()} == {
        "open": "confirmed", "close": "moved", "parse": "shadowed", "save": "shadowed", "resolve": "shadowed", "gone": "absent", "file": None,
    }
    assert evidence.verified_edges(judged).count() == 3 and evidence.rejected(judged).count() == 4
    wrong = syms.withColumn("line", F.when(F.col("node_id") == "save", 1).otherwise(F.col("line")))
    cuts = {r.node_id: r for r in evidence.slices(wrong, lines, 2).collect()}
    assert cuts["save"].line == 4 and cuts["save"].moved and cuts["save"].text == "function save() {}\nfunction resolve() {}"
    assert cuts["file"].line == 1 and not cuts["file"].moved and cuts["start"].text.startswith("function start")
    lost = spark.createDataFrame([("z", "nowhere", "", "db.js", 1, True, "s"), ("q", "q", "", "no.js", 1, True, "s")], SYM)
    assert {r.node_id: r.missing for r in evidence.slices(lost, lines).collect()} == {"z": "symbol not found in file", "q": "file not found"}
    packet = evidence.packet(syms.filter("node_id = 'open'"), syms, evidence.verified_edges(judged), lines, 4).first()
    assert packet.header == "--- db.js:1  open()  |  called by: start"


def test_descriptions_come_from_comments(spark):
    text = "#!/usr/bin/env node\n// Stores things.\n\nimport x\n/**\n * Writes one\n * row.\n */\nfunction put() {}\n\nfunction bare() {}"
    files = spark.createDataFrame([("a.js", text)], "file string, text string")
    syms = spark.createDataFrame([("put", "put", "put()", "a.js", 9, True, "s"), ("bare", "bare", "bare()", "a.js", 11, True, "s"), ("no", "no", "no", "", None, False, "s")], SYM)
    got = {r.node_id: (r.signature, r.doc, r.context) for r in evidence.describe(syms, files).collect()}
    assert got["put"] == ("function put() {}", " Writes one row. ", "Stores things.")
    assert got["bare"] == ("function bare() {}", "", "Stores things.") and got["no"] == ("", "", "")


def test_large_commits_couple_nothing_but_still_churn(spark):
    rows = [("big", 1, "ann", f"d{i}/f{i}.js") for i in range(41)] + [("edge", 2, "bob", f"d{i}/f{i}.js") for i in range(40)]
    rows += [(f"c{k}", 3, "bob", f) for k in range(2) for f in ("d0/f0.js", "d1/f1.js")] + [("huge", 4, "cy", f"x{i}.js") for i in range(3000)]
    commits = spark.createDataFrame(rows, "commit string, at long, author string, file string")
    pairs = history.cochange(commits)
    assert pairs.count() == 40 * 39 // 2
    assert pairs.filter("a = 'd0/f0.js' and b = 'd1/f1.js'").first().together == 3
    assert [(r.a, r.b) for r in history.coupling(pairs).collect()] == [("d0/f0.js", "d1/f1.js")]
    top = history.churn(commits).filter("file = 'd0/f0.js'").first()
    assert (top.commits, top.authors, top.last) == (4, 2, 3)


def test_risk_reasons(spark):
    rows = [(f"c{i}", i, "ann", "core.js") for i in range(8)] + [(f"s{i}", i, "ann", "scratch.js") for i in range(6)]
    rows += [(f"t{i}", i, "bob", f) for i in range(3) for f in ("covered.js", "tests/covered.test.js")]
    commits = spark.createDataFrame(rows, "commit string, at long, author string, file string")
    syms = spark.createDataFrame([(f, f + "_fn", "", f, 1, True, "s") for f in ("core.js", "scratch.js", "covered.js", "tests/covered.test.js", "u.js", "w.js")], SYM)
    edges = spark.createDataFrame([("u.js", "core.js"), ("w.js", "core.js"), ("tests/covered.test.js", "covered.js")], "src string, dst string")
    ranked = history.risk(commits, edges, syms, now=86400 * 2)
    first = history.riskiest(ranked).first()
    assert first.file == "core.js" and first.why == ["8 commits", "2 dependent file(s)", "no test reaches it", "one author (ann)"] and first.last_days == 1
    assert abs(first.risk - 1.15 * 1.15) < 1e-9 and ranked.filter("file like 'tests/%'").count() == 0
    assert [r.file for r in history.safest(ranked).collect()] == ["covered.js"]


def test_streams_collide_and_order(spark):
    syms = spark.createDataFrame([("a", "a", "", "m.js", 1, True, "s"), ("b", "b", "", "m.js", 10, True, "s"), ("c", "c", "", "n.js", 1, True, "s")], SYM)
    edges = spark.createDataFrame([("a", "c")], "src string, dst string")
    hunks = [("one", "m.js", 2, 3), ("two", "m.js", 4, 4), ("three", "n.js", 1, 1), ("four", "m.js", 12, 12), ("five", "o.md", 1, 2)]
    files, changes = collide.stream_changes(spark.createDataFrame(hunks, "stream string, file string, lo int, hi int"), syms)
    got = {(r.a, r.b): (r.shared_symbols, r.shared_files, r.a_needs_b, r.b_needs_a) for r in collide.compare(files, changes, edges).collect()}
    assert got == {("one", "two"): (1, 0, 0, 0), ("four", "one"): (0, 1, 0, 0), ("four", "two"): (0, 1, 0, 0), ("one", "three"): (0, 0, 1, 0), ("three", "two"): (0, 0, 0, 1)}
    names = files.select(F.col("stream").alias("name")).distinct()
    order = {r.name: r.layer for r in collide.merge_order(names, collide.dependencies(changes, edges)).collect()}
    assert order == {"three": 0, "four": 0, "five": 0, "one": 1, "two": 1}
    loop = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "y")], "name string, needs string")
    names = spark.createDataFrame([(n,) for n in "xyzw"], "name string")
    assert {r.name: r.layer for r in collide.merge_order(names, loop).collect()} == {"w": 0, "x": None, "y": None, "z": None}


def test_containment_takes_the_most_specific_root(spark):
    dirs = spark.createDataFrame([("/w/a/b",), ("/w/ab",), ("/z",)], "dir string")
    roots = spark.createDataFrame([("/w",), ("/w/a",)], "root string")
    assert {r.dir: r.root for r in explore.project_of(dirs, roots).collect()} == {"/w/a/b": "/w/a", "/w/ab": "/w", "/z": None}
