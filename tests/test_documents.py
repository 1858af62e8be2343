"""Contracts, output extraction, rules, stories, readers, snapshots and streams on fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mnemoloom.functions import text as tx
from mnemoloom.operators import contracts, evaluate, extract, freshness, memory, rules, tasks, trace, verify
from mnemoloom.sources import readers, snapshots
from mnemoloom.streaming import events as ev
from mnemoloom.streaming.runner import run_available

FILES = {
    ("web", "api.js"): 'const get = (p) => fetch(`${BASE}/api${p}`)\nexport const state = () => get("/state")\nfetch(\'/api/orders/42\')\n'
                       "await axios.post(`${INVENTORY}/api/inventory/${sku}`)\n// fetch('/api/ignored')\n",
    ("api", "src/app.js"): 'app.post("/api/inventory/:sku", h)\nrouter.get(\n  "/api/state", h)\napp.get("/api/orders/:id", h)\n',
    ("api", "app.py"): '@app.route("/api/state2", methods=["PUT"])\ndef x(): pass\n',
    ("go", "main.go"): 'http.HandleFunc("/health", h)\n',
}


@pytest.fixture(scope="module")
def sites(spark):
    files = spark.createDataFrame([(s, f"{s}/{f}", t) for (s, f), t in FILES.items()], "service string, file string, text string")
    return contracts.scan(files).cache()


def test_scan(sites):
    got = {(r.side, r.file, r.line, r.method, r.path) for r in sites.collect()}
    assert got == {
        ("consumes", "web/api.js", 2, None, "/state"), ("consumes", "web/api.js", 3, None, "/api/orders/42"),
        ("consumes", "web/api.js", 4, "POST", "/api/inventory/:_"), ("consumes", "web/api.js", 1, None, "/api:_"),
        ("provides", "api/src/app.js", 1, "POST", "/api/inventory/:_"), ("provides", "api/src/app.js", 2, "GET", "/api/state"),
        ("provides", "api/src/app.js", 4, "GET", "/api/orders/:_"), ("provides", "api/app.py", 1, "PUT", "/api/state2"),
        ("provides", "go/main.go", 1, None, "/health"),
    }
    call = sites.filter("line = 4 and side = 'consumes'").first()
    assert (call.base_name, call.dynamic, call.raw) == ("inventory", True, "/api/inventory/${sku}")


def test_match_and_orphans(spark, sites):
    edges = contracts.match(sites)
    got = {(r.path, r.confidence, r.method, r.cross_service) for r in edges.collect()}
    assert got == {("/api/inventory/:_", "pattern match", "POST", True), ("/api/state", "suffix match", "GET", True)}
    assert {r.path for r in contracts.orphan_routes(sites, edges).collect()} == {"/api/orders/:_", "/api/state2", "/health"}
    assert {r.path for r in contracts.orphan_calls(sites, edges).collect()} == {"/api/orders/42", "/api:_"}
    pairs = contracts.site_edges(sites, edges, "/api/state")
    one = pairs.first()
    assert (one.from_file, one.from_line, one.to_file, one.to_line) == ("web/api.js", 2, "api/src/app.js", 2)
    files = spark.createDataFrame([(f"{s}/{f}", t) for (s, f), t in FILES.items()], "file string, text string")
    lines = readers.source_lines(files)
    assert contracts.verified(pairs, lines).count() == 1
    moved = lines.withColumn("text", F.when(F.col("file") == "web/api.js", F.concat(F.lit("//"), "text")).otherwise(F.col("text")))
    assert contracts.verified(pairs, moved).count() == 0
    links = {(r["from"], r["to"], r["kind"]): r["count"] for r in contracts.service_links(edges, contracts.orphan_calls(sites, edges)).collect()}
    assert links == {("web", "api", "internal"): 2, ("web", contracts.OUTSIDE, "external"): 2}


def test_method_agreement_narrows(spark):
    rows = [("provides", "a", "a.js", i, m, "/x", False, False) for i, m in enumerate(["GET", "POST", None])]
    rows += [("consumes", "b", "b.js", 1, "POST", "/x", False, False), ("consumes", "b", "b.js", 2, "PUT", "/x", False, False)]
    sites = spark.createDataFrame(rows, "side string, service string, file string, line int, method string, path string, dynamic boolean, via_wrapper boolean")
    got = sorted((r.c_method, r.method) for r in contracts.match(sites).collect())
    assert got == [("POST", "POST"), ("PUT", "GET"), ("PUT", "POST"), ("PUT", "PUT")]


LOG = ["noise"] * 5 + [
    "src/a.ts(3,1): error TS2304: Cannot find name", "    at thing", "unrelated", "error[E0308]: mismatched", " --> src/main.rs:4:5", "",
    "FAILED tests/test_x.py::test_y", "ok", "--- FAIL: TestZ (0.00s)", "    z_test.go:12: boom", "make: *** [all] Error 2", "12 passed, 1 failed",
]


def test_extraction(spark):
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(LOG)], "run string, n int, text string")
    kept = [(r.n, r.reason) for r in extract.kept_lines(lines).orderBy("n").collect()]
    assert kept == [(5, "failure"), (6, "context"), (8, "failure"), (9, "context"), (11, "failure"), (13, "failure"), (14, "context"), (15, "failure"), (16, "summary")]
    assert tuple(extract.failure_counts(lines, 3).first()) == ("r", 5, 2, True, len(LOG))
    flood = spark.createDataFrame([("r", i, f"  error: {i}") for i in range(80)], "run string, n int, text string")
    shown = extract.kept_lines(flood, 10).groupBy("reason").count().collect()
    # The last kept failure carries the two lines after it, failures themselves but past the cap.
    assert {r.reason: r["count"] for r in shown} == {"failure": 10, "context": 2}
    odd = spark.createDataFrame([("q", i, f"line {i}" if i % 2 else "") for i in range(60)], "run string, n int, text string")
    runs = spark.createDataFrame([("q", 1)], "run string, code int")
    assert [r.n for r in extract.rendered(odd, runs).orderBy("n").collect()] == list(range(21, 60, 2))
    both = lines.withColumn("stream", F.lit("stderr")).unionByName(flood.withColumn("stream", F.lit("stdout")))
    got = extract.check_lines(both, 8).filter("reason = 'failure'").groupBy("place").count().collect()
    assert {r.place: r["count"] for r in got} == {0: 5, 1: 3}


def test_digest_covers_whole_texts(spark):
    text = "".join(chr(97 + i % 26) for i in range(45))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "id int, content string")
    chunks = extract.digest_chunks(df, size=10).orderBy("id", "chunk").collect()
    assert "".join(c.content for c in chunks if c.id == 1) == text and [c.chunk for c in chunks if c.id == 1] == [0, 1, 2, 3, 4]
    got = {r.id: r.content for r in extract.digest(df.filter("id < 3"), lambda s: s[:3], size=20).collect()}
    assert got == {1: "abc", 2: "sho"}


def test_verification(spark):
    facts = spark.createDataFrame(
        [(1, "config in /etc/app/conf.d.", None), (2, "route /api/state answers", None), (3, "see /etc/gone/a, /etc/gone/b and ~/x/y and /etc/gone/c", None), (4, r"at C:\work\tool", None), (5, "old /etc/gone/z", 9)],
        "id int, content string, superseded_by int",
    ).withColumn("verify_state", F.lit(None).cast("string")).withColumn("verify_note", F.lit(None).cast("string"))
    paths = spark.createDataFrame([("/etc/app/conf.d",), ("/root/x/y",)], "path string")
    got = {r.id: (r.verify_state, r.verify_note) for r in verify.reverify(facts, paths).collect()}
    assert got[1] == ("ok", "1 paths found") and got[2] == ("unknown", "names no path") and got[5] == (None, None)
    assert got[3] == ("stale", "not found: /etc/gone/a, /etc/gone/b (+1 more)") and got[4][0] == "stale"
    assert [(r.id, r.total) for r in verify.drifted(facts, paths).collect()] == [(3, 2), (4, 2)]


SIZES = {"fix the typo in the readme": "light", "what does sliceSymbol return": "light", "design the retry policy": "deep", "add a field to the form": "deep", "migrate storage unattended overnight": "hardest"}


def test_sizing(spark):
    df = spark.createDataFrame(list(SIZES.items()), "task string, want string")
    assert all(r.tier == r.want for r in rules.sized(df).collect())
    df = spark.createDataFrame([("design it", "light | small", "edit"), ("design it", "banana", "edit"), ("design it", "hardest|x", "read")], "task string, reply string, permission string")
    assert [(r.tier, r.by) for r in rules.sized(df, "task", "reply", "permission").collect()] == [("light", "the local model"), ("deep", "rules"), ("standard", "rules")]
    assert rules.tier_models({"light": "a", "deep": "b"}, {"tiers": {"light": " c ", "deep": " ", "odd": "d"}}) == {"light": "c", "deep": "b"}
    assert rules.routing_enabled("off", {"enabled": True}) is False and rules.routing_enabled(None, {"enabled": True}) is True


def test_checks_and_menu(spark):
    files = [("a", "package.json", json.dumps({"scripts": {"test": "x", "lint": "y", "dev": "z"}})), ("b", "Cargo.toml", ""), ("c", "Makefile", "all:\n\ntest : x\n"), ("d", "package.json", json.dumps({"checks": ["run it"]})), ("e", "package.json", "{"), ("e", "go.mod", "")]
    got = rules.detect_checks(spark.createDataFrame(files, "repo string, name string, text string")).orderBy("repo", "position").collect()
    assert [(r.repo, r.name) for r in got] == [("a", "lint"), ("a", "test"), ("b", "check"), ("b", "test"), ("c", "test"), ("d", "run it"), ("e", "vet"), ("e", "test")]
    items = spark.createDataFrame([("g", 0, "i", "I", None, "j"), ("g", 1, "j", "J", "tool", None), ("h", 0, "k", "K", "absent", None)], "group string, position int, id string, label string, needs string, then string")
    menu = rules.menu(items, spark.createDataFrame([("tool",)], "name string"))
    assert sorted((r.id, r.next) for r in menu.collect()) == [("i", "J"), ("j", None)]
    status = spark.createDataFrame([("s", "?? build/x"), ("t", "?? src/x"), ("u", " M build/x")], "stream string, line string")
    assert {r.stream: r.dirty for r in rules.dirty_streams(status).collect()} == {"s": False, "t": True, "u": True}


SPEC = """---
title: "Sign in"
status: done # late
---
## Code Map
- `src/a.js` -- one
- `FILE`
## Tasks & Acceptance
**Tasks:**
- [ ] skip me
**Acceptance Criteria:**
- Given a token, when it expires, then ask again
- [x] Given nothing
- PRECONDITION
## Verification
**Commands:**
- `npm test` -- all
- `COMMAND`"""


def test_stories(spark):
    files = spark.createDataFrame([("s/1-1.md", SPEC), ("s/1-2.md", "## Tasks & Acceptance\n\n**Acceptance Criteria:**\n"), ("s/readme.md", "# no")], "file string, text string")
    specs = trace.specs(files).orderBy("id").collect()
    assert [s.id for s in specs] == ["1-1", "1-2"] and (specs[0].title, specs[0].status) == ("Sign in", "done")
    assert len(specs[0].criteria) == 2 and specs[0].commands == ["npm test"] and specs[0].code_map == ["src/a.js"] and specs[1].title == "1-2"
    sprint = trace.sprint_status(spark.createDataFrame([("sprint-status.yaml", "x: 1\ndevelopment_status:\n  1-2: review\n\n  1-3: done\nother:\n  1-4: done")], "file string, text string"))
    assert {r.story: r.state for r in sprint.collect()} == {"1-2": "review", "1-3": "done"}
    judged = trace.assess(trace.specs(files), spark.createDataFrame([("src/b.js",)], "path string"), sprint)
    runs = spark.createDataFrame([("s/1-1.md", "npm test", 1)], "file string, command string, code int")
    assert trace.summary(trace.with_results(judged, runs)).first().asDict() == {"stories": 2, "criteria": 2, "declared": 1, "undeclared": 1, "unproven": 1, "failing": 1, "passing": 0, "drifted": 1}


def test_memory_lifecycle(spark):
    facts = spark.createDataFrame([(1, None), (2, 9), (3, None)], "id long, superseded_by long")
    old = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {r.id: r.superseded_by for r in memory.supersede(facts, 3, old).collect()} == {1: 3, 2: 9, 3: None}
    assert {r.id: r.superseded_by for r in memory.supersede(facts, 77, old).collect()} == {1: None, 2: 9, 3: None}
    replies = spark.createDataFrame([(1, "- decision: use parquet for everything\nshort\n2. a plain statement that is long\n" + "fact: number %d is quite long\n" * 4 % (1, 2, 3, 4)), (2, " NONE")], "id int, reply string")
    got = memory.parse_proposals(replies).orderBy("position").collect()
    assert [(r.kind, r.content) for r in got[:2]] == [("decision", "use parquet for everything"), ("fact", "a plain statement that is long")] and len(got) == 4
    pending = spark.createDataFrame([(i, "fact", f"content {i}", "", s) for i, s in ((5, "pending"), (6, "rejected"), (7, "pending"))], "id long, kind string, content string, context string, state string")
    base = spark.createDataFrame([(10, "fact", "known", "", 50, None, None)], "id long, kind string, content string, context string, priority int, verify_state string, verify_note string")
    checked = lambda df: df.withColumn("verify_state", F.lit("ok")).withColumn("verify_note", F.lit(""))
    queue, stored = memory.accept(pending, base, spark.createDataFrame([(5,), (6,), (7,)], "id long"), checked)
    assert {r.id: r.state for r in queue.collect()} == {5: "accepted", 6: "rejected", 7: "accepted"}
    assert sorted((r.id, r.content) for r in stored.collect()) == [(10, "known"), (11, "content 5"), (12, "content 7")]
    embedded = memory.embed_missing(spark.createDataFrame([(1, "a", "", None), (2, "b", "", [1.0, 0.0])], "id long, content string, context string, embedding array<float>"), lambda ts: [[3.0, 4.0] for _ in ts])
    assert {r.id: [round(x, 3) for x in r.embedding] for r in embedded.collect()} == {1: [0.6, 0.8], 2: [1.0, 0.0]}


def test_task_resume(spark):
    t = spark.createDataFrame([(1, "t", "open", "2024-01-01 00:00:00")], "id long, title string, state string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    e = spark.createDataFrame([(i, 1, f"2024-01-02 00:00:{i:02d}", "note" if i < 29 else "state", f"d{i}") for i in range(30)], "id long, task_id long, at string, kind string, detail string").withColumn("at", F.to_timestamp("at"))
    f = spark.createDataFrame([(i, 1, "fact", f"c{i}", None) for i in range(12)], "id long, task_id long, kind string, content string, superseded_by long")
    got = tasks.resume(t, e, f).first()
    assert [x.id for x in got.events] == list(range(10, 30)) and [x.id for x in got.facts] == list(range(2, 12))
    assert tasks.touched(t, e).first().state == "d29"


def test_freshness(spark):
    commits = spark.createDataFrame([("s", "c1", 5, "a.js"), ("s", "c2", 15, "a.js"), ("s", "c2", 15, "b.js"), ("s", "c3", 16, "README.md"), ("t", "c4", 1, "z.py")], "service string, commit string, at long, file string")
    built = spark.createDataFrame([("s", 10), ("t", 10)], "service string, built_at long")
    unseen = freshness.unseen_files(commits, built, spark.createDataFrame([("s", "c.js"), ("s", "dist/x.js")], "service string, file string"))
    assert freshness.staleness(unseen).first().asDict() == {"service": "s", "commits": 1, "files": 3, "uncommitted": 1}
    assert freshness.project_staleness(built.select("service"), unseen).first().asDict() == {"stale": True, "commits": 1, "behind": ["s"]}
    repos = spark.createDataFrame([("s", "abc", "def123", 1), ("t", "aaa", "aaabbb", 0), ("u", "x", "y", 41), ("v", None, "q", None)], "service string, built string, head string, behind int")
    assert {r.service: (r.total, r.files) for r in freshness.changed_code(repos, unseen, 2).collect()} == {"s": (3, ["a.js", "b.js"]), "u": (0, [])}


def test_readers(spark, tmp_path):
    doc = {"built_at_commit": "abc", "nodes": [{"id": "a", "label": "run()", "_callable": True, "source_file": "a.js", "source_location": "L3"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "source_location": "L4"}, {"source": "a", "target": "ghost"}]}
    (tmp_path / "graph.json").write_text(json.dumps(doc))
    symbols, edges = readers.graph_document(spark, str(tmp_path / "graph.json"))
    assert {(r.node_id, r.name, r.file, r.line, r.callable) for r in symbols.collect()} == {("a", "run", "a.js", 3, True), ("b", "b", "", None, False)}
    assert [(r.src, r.dst, r.relation, r.file, r.line) for r in edges.collect()] == [("a", "b", "calls", "a.js", 4)]
    say = lambda role, content: json.dumps({"type": role, "message": {"role": role, "content": content}})
    rows = [say("user", "hello"), "", "not json", say("assistant", [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "two"}]), say("user", "<tag>"), say("system", "no"), json.dumps({"role": "user", "content": " bare "})]
    (tmp_path / "t.jsonl").write_text("\n".join(rows))
    got = readers.transcripts(spark, str(tmp_path / "t.jsonl")).orderBy("position").collect()
    assert [(r.role, r.content) for r in got] == [("user", "hello"), ("assistant", "one\ntwo"), ("user", "bare")]
    (tmp_path / "log.txt").write_text("\x01h1\x0210\x02ann\n\na.js\nb/c.js\n\x01h2\x0220\x02bob\n\n")
    assert {tuple(r) for r in readers.git_log(spark, str(tmp_path / "log.txt")).collect()} == {("h1", 10, "ann", "a.js"), ("h1", 10, "ann", "b/c.js")}
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@\n+y\n@@ -9 +12 @@ f\n@@ -20,3 +22,0 @@\ndiff --git a/o b/o\n--- a/o\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    (tmp_path / "d.diff").write_text(diff)
    assert {tuple(r) for r in readers.unified_diff(spark, str(tmp_path / "d.diff")).collect()} == {("x", 3, 6), ("x", 12, 12), ("x", 22, 21)}
    tree = tmp_path / "tree"
    for name, body in {"src/a.js": "one\ntwo", "node_modules/x.js": "no", "docs/s.md": "# s", "big.js": "x" * 500_000, ".hid/h.md": "no"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(body)
    assert [(r.file, r.text) for r in readers.source_tree(spark, str(tree), "svc").collect()] == [("src/a.js", "one\ntwo")]
    assert [r.file for r in readers.named_files(spark, str(tree)).collect()] == ["docs/s.md"]
    (tmp_path / "ui.json").write_text(json.dumps({"projects": ["/a/b", 7, None, "/c?d"]}))
    assert {r.path: r.key for r in readers.registry(spark, str(tmp_path / "ui.json")).collect()} == {"/a/b": "L2EvYg", "/c?d": "L2M_ZA"}
    inventory = spark.createDataFrame([("/a/b/x", 5), ("/a/y", 7)], "path string, bytes long")
    assert {r.dir: r.bytes for r in readers.directory_bytes(inventory, spark.createDataFrame([("/a",), ("/a/b",), ("/z",)], "dir string")).collect()} == {"/a": 12, "/a/b": 5, "/z": 0}


def test_snapshots_and_bundles(spark, tmp_path):
    sym = "repo string, node_id string, label string, file string, signature string, doc string, context string"
    new = spark.createDataFrame([("r", "a", "a", "f", "s", "d", "c"), ("r", "b", "b", "f", "s2", "d", "c"), ("r", "n", "n", "f", "", "", "")], sym)
    old = spark.createDataFrame([("r", "a", "a", "f", "s", "d", "c", [1.0]), ("r", "b", "b", "f", "s", "d", "c", [2.0]), ("r", "z", "z", "", "", "", "", [3.0])], sym + ", embedding array<float>")
    symbols, changes = snapshots.import_graph(new, old)
    assert {r.node_id: r.embedding for r in symbols.collect()} == {"a": [1.0], "b": None, "n": None}
    assert {r.node_id: r.change for r in changes.collect()} == {"a": "kept", "b": "changed", "n": "new", "z": "gone"}
    root = str(tmp_path / "table")
    snapshots.publish(spark.range(1), root)
    snapshots.publish(spark.range(5), root)
    assert snapshots.current(spark, root).count() == 5
    schema = "id long, kind string, content string, superseded_by long"
    theirs = spark.createDataFrame([(1, "fact", "Shared, text", None), (2, "fact", "only theirs", None), (3, "fact", "stale theirs", 2)], schema)
    projects = spark.createDataFrame([("/p",)], "path string")
    snapshots.export_bundle({"facts": theirs, "projects": projects, "usage": spark.range(1)}, str(tmp_path / "b"))
    assert not os.path.exists(tmp_path / "b" / "usage")
    mine = {"facts": spark.createDataFrame([(7, "fact", "shared text", None)], schema), "projects": spark.createDataFrame([("/q",), ("/p",)], "path string")}
    got = snapshots.import_bundle(spark, str(tmp_path / "b"), mine)
    assert sorted((r.id, r.content) for r in got["facts"].collect()) == [(7, "shared text"), (8, "only theirs")] and got["projects"].count() == 2
    assert snapshots.import_bundle(spark, str(tmp_path / "b"), {})["facts"].count() == 3
    edges = spark.createDataFrame([("/x", "a")], "path string, to_service string")
    lone = spark.createDataFrame([("GET", "/y", "s", "f", 1, None)], "method string, path string, service string, file string, line int, base_name string")
    for project in ("one", "two", "one"):
        snapshots.save_contracts(project, edges, lone, lone, str(tmp_path / "c"))
    kept, orphans = snapshots.load_contracts(spark, "one", str(tmp_path / "c"))
    assert kept.count() == 1 and orphans.count() == 2


def session_lines(spark):
    def block(kind, *blocks, **more):
        return json.dumps({"type": kind, "message": {"content": list(blocks)}, **more})

    use = lambda i: {"type": "tool_use", "id": i, "name": "Bash", "input": {"command": f"run {i}"}}
    done = lambda i, **k: {"type": "tool_result", "tool_use_id": i, "content": [{"type": "text", "text": "x" * 1300}], **k}
    lines = [
        json.dumps({"type": "system", "subtype": "init", "session_id": "agent-1"}), "garbage",
        block("assistant", {"type": "text", "text": "hi"}, use("a"), use("b")), block("user", done("b", is_error=True)), block("user", done("a"), done("ghost")),
        json.dumps({"type": "result", "subtype": "error_max_turns", "total_cost_usd": 0.5}),
    ]
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], "session string, seq int, value string")


def test_sessions(spark):
    events = ev.parse(session_lines(spark))
    got = [(r.role, r.call_id, r.text) for r in ev.turns(events).orderBy("seq", "position").collect()]
    assert got[:3] == [("assistant", None, "hi"), ("tool", "a", "run a"), ("tool", "b", "run b")] and got[-1] == ("notice", None, "The agent stopped: error_max_turns")
    assert got[3][2].endswith("\n… 100 more characters")
    assert ev.session_state(events).first().asDict() == {"session": "s", "agent_session": "agent-1", "busy": False, "cost": 0.5, "events": 5}
    turns = ev.turns(events)
    kind = F.when(F.col("role") == "tool", "tool_use").when(F.col("role") == "result", "tool_result")
    calls = turns.select(F.col("session").alias("session_id"), "seq", kind.alias("kind"), "call_id", F.length("text").alias("chars"), "failed").filter("kind is not null")
    assert {r.call_id: r.state for r in ev.pair_calls(calls).collect()} == {"a": "done", "b": "failed"}


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.txt").write_text("\n".join(json.dumps({"type": "user" if i % 2 else "assistant", "message": {"content": "x"}, "k": i}) for i in range(k * 4, k * 4 + 4)))
    shape = lambda df: ev.parse(df).withColumn("session", F.lit("s")).withColumn("seq", F.try_variant_get("event", "$.k", "int"))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))
    streamed = run_available(ev.session_state(shape(lines)), ["session"]).first()
    assert streamed == ev.session_state(shape(spark.read.text(str(src)))).first()
    usage = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "u", 1) for m in (0, 10, 24, 40, 41)], "at string, tool string, out_chars int").withColumn("at", F.to_timestamp("at"))
    spans = ev.active_periods(usage, ["tool"]).orderBy("started").collect()
    assert [r.calls for r in spans] == [3, 2]
    t = spark.createDataFrame([(1, "s", "user", "token = 'abcdefgh12345'")], "id long, session_id string, role string, content string")
    t.write.parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "turns"))
    ev.capture_turns(stream, str(tmp_path / "l0"), str(tmp_path / "cp")).awaitTermination()
    assert "[redacted]" in spark.read.parquet(str(tmp_path / "l0")).first().content
    calls = spark.createDataFrame([("s", "a", "2024-01-01 00:00:00"), ("s", "b", "2024-01-01 00:00:05")], "session_id string, call_id string, at string").withColumn("at", F.to_timestamp("at"))
    paired = ev.join_calls(calls, calls.filter("call_id = 'a'")).select("c.call_id", F.col("r.call_id").alias("answer")).collect()
    assert {r.call_id: r.answer for r in paired} == {"a": "a", "b": None}


def test_containment_of_short_and_long_questions(spark):
    docs = spark.createDataFrame([(1, "xAlpha beta gamma delta epsilon zeta etay"), (2, "nothing here")], "id int, content string")
    asked = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta"), (2, "othing"), (3, "beta delta"), (4, "alpha beta gamma delta epsilon zeta")], "qid int, text string")
    assert {tuple(r) for r in evaluate.containing(docs, asked).select("qid", "id").collect()} == {(1, 1), (2, 2)}
    sizes = evaluate.packet_size(spark.createDataFrame([(1, "a", 10), (1, "a", 15)], "qid int, file string, chars int"), spark.createDataFrame([("a", 100)], "file string, size int")).first()
    assert (sizes.packet, sizes.baseline, sizes.smaller_pct) == (25, 100, 75.0)
    assert [r[0] for r in spark.createDataFrame([(5e8,), (3e9,), (2e3,)], "b double").select(tx.human_bytes("b")).collect()] == ["500 MB", "3.0 GB", "2 KB"]


def test_project_views(spark):
    from mnemoloom.operators import projects

    roots = spark.createDataFrame([("/w",), ("/v",)], "path string")
    repos = lambda *r: spark.createDataFrame([(x, "open") for x in r], "repo string, state string")
    got = projects.cards(roots, repos("/w", "/w"), repos("/v"), spark.createDataFrame([("/w", 9)], "repo string, symbols int"), spark.createDataFrame([("/w", "t")], "repo string, name string"))
    assert {r.path: (r.streams, r.tasks, r.symbols, r.checks) for r in got.collect()} == {"/w": (2, 0, 9, 1), "/v": (0, 1, 0, 0)}
    sessions = spark.createDataFrame([(1, "/w", "exited", 5), (2, "/w/s", "running", 3), (3, "/w-fix", "exited", 9), (4, "/other", "running", 9)], "id int, cwd string, state string, started int")
    streams = spark.createDataFrame([("fix", "/w/s", "/w-fix")], "name string, repo string, path string")
    assert [(r.id, r.stream) for r in projects.sessions_of(sessions, "/w", streams).collect()] == [(2, None), (3, "fix"), (1, None)]
    unseen = spark.createDataFrame([("s", "c", f"f{i:02d}.js") for i in range(30)], "service string, commit string, file string")
    line = projects.drift_header(unseen).first()
    assert line.total == 30 and line.line.endswith("s/f23.js + 6") and projects.drift_header(unseen.limit(0)).count() == 0
    facts = spark.createDataFrame([(i, f"fact {i}", 50, None, None) for i in range(9)], "id int, content string, priority int, verify_state string, superseded_by int")
    stories = spark.createDataFrame([("1-1", "t", "ready"), ("1-2", "u", "done")], "id string, title string, state string")
    work = spark.createDataFrame([(1, "a", "open", 5)], "id int, title string, state string, updated_at int")
    checks = spark.createDataFrame([("npm test", 0)], "command string, position int")
    got = projects.context_lines(checks, work, stories, facts).orderBy("section", "position").collect()
    assert [r.line for r in got][:4] == ["npm test", "  - task 1: a", "  - 1-1: t [ready]", "  - fact 8"] and len(got) == 9
    new = spark.createDataFrame([("fact", "at /etc/gone/x"), ("fact", "plain")], "kind string, content string")
    base = spark.createDataFrame([(4, "fact", "x", "ok", "")], "id long, kind string, content string, verify_state string, verify_note string")
    saved = verify.save_facts(base, new, spark.createDataFrame([("/etc/hosts",)], "path string"))
    assert {(r.id, r.verify_state) for r in saved.collect()} == {(4, "ok"), (5, "stale"), (6, "unknown")}


def test_store(spark, tmp_path):
    from mnemoloom.api import Store

    store = Store(spark, str(tmp_path / "store"))
    assert store.read("facts").count() == 0
    new = spark.createDataFrame([("fact", "the parser lives in lib", "build"), ("decision", "storage is columnar parquet", "")], "kind string, content string, context string")
    store.memory_save_fact(new, spark.createDataFrame([("/etc",)], "path string"))
    got = [(r.key, r.line) for r in store.memory_recall("where is the parser").collect()]
    assert got == [("L1:2", "[L1:2] (fact @build) the parser lives in lib")]
    store.memory_supersede(1, [2])
    assert store.memory_recall("where is the parser").count() == 0 and store.memory_recall("parser", include_superseded=True).count() == 1
    for body in ("one", "two"):
        store.memory_context_write(spark.createDataFrame([("a/b", body, "s")], "path string, content string, summary string"))
    assert [(r.content, r.version) for r in store.memory_context_read("a/b").collect()] == [("two", 2)]
    store.publish("tasks", spark.createDataFrame([(1, "t", "open", None)], "id long, title string, state string, updated_at timestamp"))
    event = spark.createDataFrame([(1, "odd", "tried it")], "task_id long, kind string, detail string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    store.task_note(event)
    resumed = store.task_resume(1).first()
    assert [(e.kind, e.detail) for e in resumed.events] == [("note", "tried it")] and resumed.updated_at is not None
    sym = spark.createDataFrame([("r", "p", "parseFile", "parseFile()", "a.js", 1, True), ("r", "q", "run", "run()", "a.js", 2, True)], "repo string, node_id string, name string, label string, file string, line int, callable boolean")
    store.publish("symbols", sym)
    store.publish("edges", spark.createDataFrame([("r", "q", "p", "a.js", 3)], "repo string, src string, dst string, file string, line int"))
    lines = spark.createDataFrame([("a.js", 1, "function parseFile() {}"), ("a.js", 2, "function run() {"), ("a.js", 3, "  parseFile()")], "file string, line int, text string")
    packet = store.code_context("r", "who parses a file", lines, limit=1).first()
    assert packet.node_id == "p" and packet.header.endswith("called by: run")
    assert store.graph_path("r", "q", "p")["hops"] == 1
