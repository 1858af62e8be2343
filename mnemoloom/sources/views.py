"""Model tables projected from the relational test tables.

Each model table has a Spark form (`views.facts(spark, path)`) and the same
definition as portable SQL (`SQL["facts"]`), which the oracle queries use.
Every projection reads its whole source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import spread


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def facts(spark: SparkSession, path: str) -> DataFrame:
    docs = spread(table(spark, path, "documents"), "doc_id")
    # One label per document; saying so lets the join vanish from queries that use no label.
    labels = table(spark, path, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("kind"),
        F.col("source").alias("context"),
        F.col("text").alias("content"),
        F.coalesce(F.col("quality") * 50, F.lit(25)).alias("priority"),
        F.when(F.col("toxic") == 1, "stale").when(F.col("toxic") == 0, "ok").alias("verify_state"),
        F.when(F.col("quality") == 0, F.col("doc_id") + 1).alias("superseded_by"),
    )


def turns(spark: SparkSession, path: str) -> DataFrame:
    return spread(table(spark, path, "conversations"), "conv_id", "turn").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn"),
        "role",
        F.col("text").alias("content"),
    )


def pending(spark: SparkSession, path: str) -> DataFrame:
    state = F.when(F.col("role") == "assistant", "pending").when(F.col("role") == "user", "accepted")
    return turns(spark, path).select("id", "session_id", "content", state.otherwise("rejected").alias("state"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def usage(spark: SparkSession, path: str) -> DataFrame:
    return usage_from(table(spark, path, "events"))


def usage_from(events: DataFrame) -> DataFrame:
    out_chars = F.floor("value").cast("bigint")
    measured = F.col("event_type").isin("view", "click")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_type").alias("tool"),
        F.col("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("in_chars"),
        out_chars.alias("out_chars"),
        F.when(measured, out_chars * 2).alias("baseline_chars"),
    )


def tasks(spark: SparkSession, path: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done")
    return table(spark, path, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_custkey").alias("repo"),
        state.otherwise("blocked").alias("state"),
        F.col("o_orderdate").alias("updated_at"),
    )


def task_events(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("task_id"),
        F.col("ts").alias("at"),
        F.col("event_type").alias("kind"),
        F.col("props").alias("detail"),
    )


def _part_file() -> Column:
    place = F.when(F.col("p_type") == "SMALL", "/tests/m").otherwise("/src/m")
    return F.concat("p_brand", place, F.expr("p_partkey div 200").cast("string"), F.lit(".js"))


def symbols(spark: SparkSession, path: str) -> DataFrame:
    callable_ = F.col("p_type") != "ECONOMY"
    return table(spark, path, "part").select(
        F.col("p_partkey").alias("node_id"),
        F.col("p_name").alias("name"),
        F.when(callable_, F.concat("p_name", F.lit("()"))).otherwise(F.col("p_name")).alias("label"),
        _part_file().alias("file"),
        F.col("p_size").alias("line"),
        callable_.alias("callable"),
        F.col("p_brand").alias("service"),
        F.col("p_type").alias("doc"),
    )


def links(spark: SparkSession, path: str) -> DataFrame:
    """Recorded links, dangling ones included; `graph.valid_edges` drops those."""
    return table(spark, path, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"), F.col("l_linenumber").alias("line")
    )


def commit_files(spark: SparkSession, path: str) -> DataFrame:
    orders = table(spark, path, "orders").filter("o_orderstatus <> 'P'")
    items = table(spark, path, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, path, "part").select("p_partkey", _part_file().alias("file"))
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderkey").alias("commit"),
            F.unix_timestamp("o_orderdate").alias("at"),
            F.col("o_custkey").alias("author"),
            "file",
        )
        .distinct()
    )


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """Changed line ranges per work stream; a stream is the supplier's nation."""
    items = table(spark, path, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    parts = table(spark, path, "part").select("p_partkey", _part_file().alias("file"))
    # 25 rows by definition of the table.
    nations = F.broadcast(table(spark, path, "nation").select("n_nationkey", "n_name"))
    suppliers = table(spark, path, "supplier").select("s_suppkey", "s_nationkey").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    lo = F.col("l_quantity").cast("int")
    return (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("n_name").alias("stream"), "file", lo.alias("lo"), (lo + F.col("l_linenumber") - 1).alias("hi"))
    )


def routes(spark: SparkSession, path: str) -> DataFrame:
    """Pages as the two halves of HTTP contracts: https pages serve, http pages call."""
    url = F.col("url")
    host = F.regexp_extract(url, "://([^/]+)", 1)
    wrapper = (F.col("side") == "consumes") & F.col("file").rlike(r"^(m|blog)\.")
    whole = tx.normalise_path(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"/[0-9]{3,}", "/:id"))
    return (
        table(spark, path, "pages")
        .select(
            F.when(url.startswith("https:"), "provides").otherwise("consumes").alias("side"),
            F.regexp_extract(host, r"([a-z0-9-]+\.[a-z]+)$", 1).alias("service"),
            host.alias("file"),
            F.col("page_id").alias("line"),
            F.when(url.contains("utm_source"), "POST").when(url.contains("page="), "GET").alias("method"),
            whole.alias("whole"),
            url.contains(".html").alias("dynamic"),
        )
        .select(
            "side", "service", "file", "line", "method", "dynamic", wrapper.alias("via_wrapper"),
            # A wrapper holds the first segment, so its callers only name the rest.
            F.when(wrapper, F.regexp_replace("whole", "^/[^/]+", "")).otherwise(F.col("whole")).alias("path"),
        )
    )


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """A small module per page: https pages declare their route, http pages fetch theirs."""
    url = F.col("url")
    host = F.regexp_extract(url, "://([^/]+)", 1)
    raw = F.regexp_extract(url, r"://[^/]+(/[^?#]*)", 1)
    declares = F.concat(
        F.lit('// router.get("/left/out", handler)\nimport handler from "./handler"\nrouter.post("'),
        F.regexp_replace(raw, "/[0-9]+", "/:id"), F.lit('", handler)\n'),
    )
    calls = F.concat(F.lit("async function load() {\n  return fetch(`${BILLING_URL}"), raw, F.lit("`)\n}\n"))
    return spread(table(spark, path, "pages").select("page_id", "url"), "page_id").select(
        F.regexp_extract(host, r"([a-z0-9-]+\.[a-z]+)$", 1).alias("service"),
        F.concat(host, F.lit("/p"), F.col("page_id").cast("string"), F.lit(".js")).alias("file"),
        F.when(url.startswith("https:"), declares).otherwise(calls).alias("text"),
    )


def code_symbols(spark: SparkSession, path: str) -> DataFrame:
    """The same symbols under names that can be written in code."""
    return symbols(spark, path).withColumn("name", F.concat(F.lit("part"), F.col("node_id").cast("string"))).withColumn(
        "label", F.concat("name", F.lit("()"))
    )


def call_sites(spark: SparkSession, path: str) -> DataFrame:
    """Every valid link with its recorded call site, wrong for the last line of an order, and the true one."""
    parts = code_symbols(spark, path)
    src = parts.select(F.col("node_id").alias("src"), "file")
    dst = parts.select(F.col("node_id").alias("dst"), "name", "callable")
    true_line = (F.lit(1000) + F.col("dst") * 10 + F.col("l")).cast("int")
    links_ = links(spark, path).withColumnRenamed("line", "l")
    return links_.join(src, "src").join(dst, "dst").select(
        "src", "dst", "file", "name", "callable", true_line.alias("true_line"),
        F.when(F.col("l") == 7, F.lit(9) - true_line).otherwise(true_line).alias("line"),
    )


def source_lines(spark: SparkSession, path: str) -> DataFrame:
    """Definitions at their lines, calls at theirs; an uncallable symbol is only called through an object."""
    parts = code_symbols(spark, path)
    definition = F.concat(F.lit("function "), "name", F.lit("(a) {}"))
    defs = parts.groupBy("file", "line").agg(F.array_join(F.array_sort(F.collect_set(definition)), " ").alias("text"))
    call = F.concat(F.when(F.col("callable"), "  ").otherwise("  x."), "name", F.lit("(y)"))
    calls = call_sites(spark, path).select("file", F.col("true_line").alias("line"), call.alias("text")).distinct()
    return defs.unionByName(calls)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "benchmark").select(F.col("item_id").alias("qid"), "text")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tool output: three lines per event, one run per user."""
    kind = F.col("event_type")
    first = (
        F.when(kind == "error", F.concat(F.lit("error: rejected "), "props"))
        .when(kind == "purchase", F.lit("3 passed"))
        .otherwise(F.concat(F.lit("step "), kind))
    )
    lines = F.array(first, F.concat(F.lit("    at value "), F.col("value").cast("string")), F.lit("done"))
    return table(spark, path, "events").select(
        F.col("user_id").alias("run"), F.col("event_id"), F.posexplode(lines).alias("k", "text")
    ).select("run", (F.col("event_id") * 3 + F.col("k")).alias("n"), "text")


def task_texts(spark: SparkSession, path: str) -> DataFrame:
    """A task in words for every order, its urgency deciding what is asked."""
    key = F.col("o_orderkey").cast("string")
    p = F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.concat(F.lit("Redesign and migrate shipment "), key, F.lit(" unattended, overnight")))
        .when(p == "2-HIGH", F.concat(F.lit("Investigate why shipment "), key, F.lit(" is late")))
        .when(p == "3-MEDIUM", F.concat(F.lit("Rename the label of shipment "), key))
        .when(p == "5-LOW", F.concat(F.lit("What does shipment "), key, F.lit(" contain")))
        .otherwise(F.concat(F.lit("Build shipment "), key))
    )
    long = F.when(F.col("o_orderstatus") == "P", F.repeat(F.lit(" and then the next one"), 5)).otherwise("")
    return spread(table(spark, path, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("id"), F.concat(text, long).alias("task"), F.col("o_orderstatus").alias("mode"))


def worktrees(spark: SparkSession, path: str) -> DataFrame:
    """Customers as registered work streams in every state."""
    seg = F.col("c_mktsegment")
    return table(spark, path, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_nationkey") != 3).alias("exists"), (F.col("c_nationkey") == 5).alias("dirty"),
        (seg == "MACHINERY").alias("pinned"), (seg == "BUILDING").alias("merged"),
        (F.col("c_acctbal") < 1000).alias("untouched"), (seg == "HOUSEHOLD").alias("evaluated"),
        F.lit("2024-01-05T10:00:00Z").alias("evaluated_at"), F.floor(F.col("c_acctbal") / 100).cast("int").alias("age_days"),
        F.when(seg == "FURNITURE", 0).otherwise(F.col("c_nationkey") * 1000).alias("build_bytes"),
        F.col("c_nationkey").alias("unmerged_commits"), F.lit("main").alias("base"),
    )


def path_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts naming paths: where each page is served from, and where it is copied to."""
    raw = F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1)
    text = F.concat(
        F.lit("Served from "), raw, F.lit(". Copied to C:\\site\\"), F.col("page_id").cast("string"),
        F.lit(" and (/srv/www"), raw, F.lit("), see /start, http://h/a/b and /path/to/it"),
    )
    return table(spark, path, "pages").select(
        F.col("page_id").alias("id"), text.alias("content"), F.lit(None).cast("bigint").alias("superseded_by")
    )


def known_paths(spark: SparkSession, path: str) -> DataFrame:
    """An inventory of paths: one per document, under its language."""
    return table(spark, path, "documents").select(
        F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path")
    )


def spec_files(spark: SparkSession, path: str) -> DataFrame:
    """A story specification per order, more or less complete."""
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "in-review # soon")
    criteria = F.array_join(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("- [ ] Given case "), i.cast("string"))), "\n"
    )
    command = F.when(n <= 2, "- `make check`").otherwise("- `COMMAND`")
    text = F.concat(
        F.lit("---\ntitle: 'Order'\nstatus: "), state.otherwise("ready"), F.lit("\n---\n\n## Code Map\n- `src/"),
        F.col("o_custkey").cast("string"), F.lit(".js` -- read\n- `FILE`\n\n## Tasks & Acceptance\n\n**Tasks:**\n- [x] one\n\n"),
        F.lit("**Acceptance Criteria:**\n"), criteria, F.lit("\n\n## Verification\n\n**Commands:**\n"), command, F.lit("\n"),
    )
    return spread(table(spark, path, "orders"), "o_orderkey").select(
        F.concat(F.lit("stories/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("file"), text.alias("text")
    )


def tool_events(spark: SparkSession, path: str) -> DataFrame:
    """Each user turn as a tool call, each assistant turn as the result for the turn before it."""
    t = turns(spark, path)
    kind = F.when(F.col("role") == "user", "tool_use").when(F.col("role") == "assistant", "tool_result")
    call = F.when(F.col("role") == "assistant", F.col("id") - 1).otherwise(F.col("id"))
    return t.select(
        "session_id", F.col("id").alias("seq"), kind.alias("kind"), call.alias("call_id"),
        F.length("content").cast("bigint").alias("chars"),
    ).filter("kind is not null")


def session_events(spark: SparkSession, path: str) -> DataFrame:
    """Conversations as protocol events (session, seq, at, line): system turns open a session, user turns answer a call, every
    fourth turn of an assistant closes its work, its others speak and call a tool. Some say that nobody is signed in."""
    t = table(spark, path, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", F.col("text"))
    seq, session = F.col("seq"), F.col("session")
    word = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    message = lambda *blocks: F.struct(F.array(*blocks).alias("content"))
    init = F.to_json(
        F.struct(
            F.lit("system").alias("type"), F.lit("init").alias("subtype"), word("agent-", session).alias("session_id"),
            F.when(session % 2 == 0, F.array(F.lit("Read"), F.lit("Bash"))).otherwise(F.array(F.lit("Read"))).alias("tools"),
        )
    )
    answer = F.struct(
        F.lit("tool_result").alias("type"), word("c", seq - 1).alias("tool_use_id"), F.col("text").alias("content"), (seq % 5 == 0).alias("is_error")
    )
    spoken = F.when((session + seq) % 7 == 0, F.concat(F.lit("Invalid API key. "), F.col("text"))).otherwise(F.col("text"))
    # The two kinds of blocks have the fields of both.
    says = F.struct(F.lit("text").alias("type"), spoken.alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"))
    call = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), word("c", seq).alias("id"), F.lit("Read").alias("name"))
    result = F.struct(
        F.lit("result").alias("type"), F.when(session % 3 == 0, "error_max_turns").otherwise("success").alias("subtype"), (seq / 8).alias("total_cost_usd")
    )
    line = (
        F.when(F.col("role") == "system", init)
        .when(F.col("role") == "user", F.to_json(F.struct(F.lit("user").alias("type"), message(answer).alias("message"))))
        .when(seq % 4 == 3, F.to_json(result))
        .otherwise(F.to_json(F.struct(F.lit("assistant").alias("type"), message(says, call).alias("message"))))
    )
    at = F.timestamp_seconds(F.lit(1704067200) + session % 1000 * 3600 + seq * 60)
    return t.select("session", "seq", at.alias("at"), line.alias("line"))


# The same projections as portable SQL, for the oracle.
_FILE = "p_brand || CASE WHEN p_type = 'SMALL' THEN '/tests/m' ELSE '/src/m' END || (p_partkey // 200) || '.js'"
SQL: dict[str, str] = {
    "facts": """
        SELECT d.doc_id AS id, d.lang AS kind, d.source AS context, d.text AS content,
               coalesce(l.quality * 50, 25) AS priority,
               CASE l.toxic WHEN 1 THEN 'stale' WHEN 0 THEN 'ok' END AS verify_state,
               CASE WHEN l.quality = 0 THEN d.doc_id + 1 END AS superseded_by
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "turns": "SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn, role, text AS content FROM conversations",
    "pending": """
        SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, text AS content,
               CASE role WHEN 'assistant' THEN 'pending' WHEN 'user' THEN 'accepted' ELSE 'rejected' END AS state
        FROM conversations""",
    "vectors": "SELECT vec_id AS id, embedding, label FROM embeddings",
    "usage": r"""
        SELECT event_id AS id, ts AS "at", event_type AS tool, user_id,
               CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS in_chars,
               CAST(floor(value) AS BIGINT) AS out_chars,
               CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value) AS BIGINT) * 2 END AS baseline_chars
        FROM events""",
    "tasks": """
        SELECT o_orderkey AS id, o_orderpriority AS title, o_custkey AS repo,
               CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'blocked' END AS state,
               o_orderdate AS updated_at
        FROM orders""",
    "task_events": """
        SELECT event_id AS id, user_id AS task_id, ts AS "at", event_type AS kind, props AS detail FROM events""",
    "symbols": f"""
        SELECT p_partkey AS node_id, p_name AS name,
               CASE WHEN p_type <> 'ECONOMY' THEN p_name || '()' ELSE p_name END AS label,
               {_FILE} AS file, p_size AS line, p_type <> 'ECONOMY' AS callable, p_brand AS service, p_type AS doc
        FROM part""",
    "links": "SELECT l_partkey AS src, l_orderkey AS dst, l_linenumber AS line FROM lineitem",
    "edges": """
        SELECT l_partkey AS src, l_orderkey AS dst, l_linenumber AS line FROM lineitem
        WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_orderkey IN (SELECT p_partkey FROM part)""",
    "commit_files": f"""
        SELECT DISTINCT o_orderkey AS "commit", CAST(epoch(o_orderdate) AS BIGINT) AS "at", o_custkey AS author,
               {_FILE} AS file
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        WHERE o_orderstatus <> 'P'""",
    "ranges": f"""
        SELECT n_name AS stream, {_FILE} AS file, CAST(l_quantity AS INTEGER) AS lo,
               CAST(l_quantity AS INTEGER) + l_linenumber - 1 AS hi
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey""",
    "routes": r"""
        SELECT side, service, file, line, method, dynamic, via_wrapper,
               CASE WHEN via_wrapper THEN regexp_replace(whole, '^/[^/]+', '') ELSE whole END AS path
        FROM (SELECT *, side = 'consumes' AND regexp_matches(file, '^(m|blog)\.') AS via_wrapper
              FROM (SELECT CASE WHEN url LIKE 'https:%' THEN 'provides' ELSE 'consumes' END AS side,
                           regexp_extract(regexp_extract(url, '://([^/]+)', 1), '([a-z0-9-]+\.[a-z]+)$', 1) AS service,
                           regexp_extract(url, '://([^/]+)', 1) AS file, page_id AS line,
                           CASE WHEN url LIKE '%utm!_source%' ESCAPE '!' THEN 'POST'
                                WHEN url LIKE '%page=%' THEN 'GET' END AS method,
                           {normalised} AS whole, url LIKE '%.html%' AS dynamic
                    FROM pages))""",
    "questions": "SELECT item_id AS qid, text FROM benchmark",
    "log_lines": """
        SELECT user_id AS run, event_id * 3 + k AS n,
               CASE k WHEN 0 THEN CASE event_type WHEN 'error' THEN 'error: rejected ' || props
                                                  WHEN 'purchase' THEN '3 passed' ELSE 'step ' || event_type END
                      WHEN 1 THEN '    at value ' || CAST(value AS VARCHAR) ELSE 'done' END AS text
        FROM events, (SELECT unnest([0, 1, 2]) AS k)""",
    "session_rows": """
        SELECT conv_id AS session, turn AS seq, text,
               CASE WHEN role = 'system' THEN 'system' WHEN role = 'user' THEN 'user' WHEN turn % 4 = 3 THEN 'result' ELSE 'assistant' END AS kind
        FROM conversations""",
    "tool_events": """
        SELECT conv_id AS session_id, conv_id * 1000 + turn AS seq,
               CASE role WHEN 'user' THEN 'tool_use' ELSE 'tool_result' END AS kind,
               conv_id * 1000 + turn - CASE role WHEN 'assistant' THEN 1 ELSE 0 END AS call_id,
               CAST(length(text) AS BIGINT) AS chars
        FROM conversations WHERE role IN ('user', 'assistant')""",
}


def sql_normalise_path(expr: str) -> str:
    """`functions.text.normalise_path` in the oracle's dialect."""
    steps = [
        (r"(?i)^[a-z]+://[^/]+", "", ""),
        (r"\?.*$", "", ""),
        (r"\$\{[^}]*\}", ":_", "g"),
        (r":[A-Za-z_][0-9A-Za-z_]*", ":_", "g"),
        (r"\{[^}]*\}", ":_", "g"),
        (r"<[^>]*>", ":_", "g"),
        (r"/+$", "", ""),
    ]
    out = f"trim({expr})"
    for pattern, to, flags in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}'{', ' + repr(flags) if flags else ''})"
    return f"lower(CASE WHEN starts_with({out}, '/') THEN {out} ELSE '/' || {out} END)"


SQL["routes"] = SQL["routes"].replace(
    "{normalised}",
    sql_normalise_path("regexp_replace(regexp_replace(url, '#.*$', ''), '/[0-9]{3,}', '/:id', 'g')"),
)


def with_views(names: str, body: str) -> str:
    """Prefix a query with the named projections as common table expressions."""
    recursive = "RECURSIVE " if body.lstrip().upper().startswith("RECURSIVE") else ""
    body = body.lstrip()[len("RECURSIVE"):] if recursive else body
    ctes = ",\n".join(f'"{n}" AS ({SQL[n]})' for n in names.split())
    joiner = ",\n" if body.lstrip().startswith(",") else "\n"
    return f"WITH {recursive}{ctes}{joiner}{body.lstrip().lstrip(',')}"
