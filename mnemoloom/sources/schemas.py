"""Explicit schemas of the stored tables and the incoming documents, as DDL."""

FACTS = (
    "id bigint, kind string, content string, context string, priority int, version int, created_at timestamp, "
    "updated_at timestamp, embedding array<float>, superseded_by bigint, superseded_at timestamp, "
    "verify_state string, verify_note string, verified_at timestamp, task_id bigint"
)
SCENARIOS = (
    "path string, content string, summary string, version int, updated_at timestamp, embedding array<float>"
)
TURNS = ("id bigint, session_id string, role string, content string, created_at timestamp")
PENDING = (
    "id bigint, session_id string, kind string, content string, context string, source string, state string, "
    "created_at timestamp"
)
USAGE = (
    "id bigint, at timestamp, tool string, in_chars bigint, out_chars bigint, baseline_chars bigint"
)
TASKS = (
    "id bigint, title string, repo string, branch string, stream string, story string, state string, "
    "created_at timestamp, updated_at timestamp"
)
TASK_EVENTS = ("id bigint, task_id bigint, at timestamp, kind string, detail string")
REPOS = (
    "repo string, built_at_commit string, imported_at timestamp, symbols bigint, edges bigint"
)
SYMBOLS = (
    "repo string, node_id string, name string, label string, file string, line int, callable boolean, "
    "signature string, doc string, context string, embedding array<float>"
)
EDGES = ("repo string, src string, dst string, relation string, file string, line int")
ROUTES = (
    "side string, service string, file string, line int, method string, path string, raw string, base string, "
    "base_name string, dynamic boolean, via_wrapper boolean, text string"
)
STREAMS = (
    "name string, repo string, path string, branch string, base string, base_at string, pinned boolean, "
    "evaluated boolean, evaluated_at string"
)
SOURCE_LINES = ("file string, line int, text string")

GRAPH_DOCUMENT = (
    "built_at_commit string, "
    "nodes array<struct<id: string, label: string, _callable: boolean, source_file: string, source_location: string>>, "
    "links array<struct<source: string, target: string, relation: string, source_file: string, "
    "source_location: string>>"
)
