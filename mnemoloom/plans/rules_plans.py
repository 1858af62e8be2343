"""Output extraction, path claims, decision tables, stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import extract, freshness, rules, trace, verify
from ..sources import views as v
from .registry import query


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FAIL = f"regexp_matches(text, {_re('|'.join(fixed.FAILURE_PATTERNS))})"
_SUM = f"regexp_matches(text, {_re('|'.join(fixed.SUMMARY_PATTERNS))})"


@query("log_lines", f"SELECT run, n, text FROM log_lines WHERE {_FAIL}")
def failure_lines(spark, path):
    return extract.flagged(v.log_lines(spark, path)).filter("reason = 'failure'").select("run", "n", "text")


@query(
    "log_lines",
    f""", f AS (SELECT run, n, row_number() OVER (PARTITION BY run ORDER BY n) AS rank FROM log_lines WHERE {_FAIL}),
        top AS (SELECT run, n FROM f WHERE rank <= 10),
        ctx AS (SELECT DISTINCT l.run, l.n FROM log_lines l JOIN top t ON l.run = t.run AND l.n IN (t.n + 1, t.n + 2)
                WHERE regexp_matches(l.text, {_re(fixed.CONTEXT_PATTERN)}) AND trim(l.text) <> '')
        SELECT l.run, l.n, CASE WHEN t.n IS NOT NULL THEN 'failure' WHEN NOT {_FAIL} AND {_SUM} THEN 'summary'
                                ELSE 'context' END AS reason
        FROM log_lines l LEFT JOIN top t ON l.run = t.run AND l.n = t.n LEFT JOIN ctx c ON l.run = c.run AND l.n = c.n
        WHERE t.n IS NOT NULL OR c.n IS NOT NULL OR (NOT {_FAIL} AND {_SUM})""",
)
def failure_context(spark, path):
    return extract.kept_lines(v.log_lines(spark, path), max_failures=10).select("run", "n", "reason")


@query(
    "log_lines",
    f"""SELECT run, count(*) FILTER ({_FAIL}) AS failures, greatest(count(*) FILTER ({_FAIL}) - 10, 0) AS truncated,
               bool_or({_FAIL} OR {_SUM}) AS recognised, count(*) AS total_lines FROM log_lines GROUP BY run""",
)
def failure_counts(spark, path):
    return extract.failure_counts(v.log_lines(spark, path), 10)


@query(
    "log_lines",
    """SELECT run, n, text FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC) AS r FROM log_lines
       WHERE text <> '') WHERE r <= 20""",
)
def log_tail(spark, path):
    return extract.tail(v.log_lines(spark, path))


@query(
    "",
    """WITH results AS (SELECT o_custkey AS repo, o_orderkey AS position, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS code FROM orders),
         stops AS (SELECT repo, min(position) FILTER (code <> 0) AS stop, count(*) AS total FROM results GROUP BY repo)
       SELECT repo, bool_and(code = 0) AS passed, count(*) AS ran, any_value(total) AS total
       FROM results JOIN stops USING (repo) WHERE stop IS NULL OR position <= stop GROUP BY repo""",
)
def gate_verdict(spark, path):
    """Each customer's orders as the checks of a gate that stops at the first failure."""
    results = v.table(spark, path, "orders").select(
        F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("position"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("code"),
    )
    return extract.gate_verdict(results)


@query(
    "facts",
    """SELECT id, CAST(c AS INTEGER) AS chunk, length(substr(content, c * 2000 + 1, 2000)) AS chars
       FROM (SELECT id, content, unnest(range(CAST(ceil(length(content) / 2000) AS BIGINT))) AS c FROM facts)""",
)
def digest_chunks(spark, path):
    chunks = extract.digest_chunks(v.facts(spark, path), size=2000)
    return chunks.select("id", "chunk", F.length("content").cast("bigint").alias("chars"))


_CLAIM_TEXT = r"""SELECT page_id AS id, 'Served from ' || raw || '. Copied to C:\site\' || page_id || ' and (/srv/www' || raw ||
                         '), see /start, http://h/a/b and /path/to/it' AS content
                  FROM (SELECT page_id, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS raw FROM pages)"""
_CLAIMS = f"""
    told AS ({_CLAIM_TEXT}),
    raw_claims AS (SELECT id, unnest(list_distinct(list_transform(list_concat(
        regexp_extract_all(content, {_re(fixed.WINDOWS_PATH)}), regexp_extract_all(content, {_re(fixed.POSIX_PATH)}, 1)),
        lambda p: regexp_replace(p, {_re(fixed.CLAIM_TRAILING)}, '')))) AS claim FROM told),
    claims AS (SELECT id, claim FROM raw_claims WHERE length(claim) >= 4
        AND NOT regexp_matches(claim, {_re(fixed.CLAIM_PLACEHOLDER)}) AND NOT regexp_matches(claim, {_re(fixed.CLAIM_URL)})
        AND len(list_filter(string_split_regex(claim, '[\\\\/]+'), lambda s: s <> '')) >= 2),
    known AS (SELECT DISTINCT '/' || lang || '/' || doc_id AS path, lang FROM documents),
    held AS (SELECT id, claim, claim IN (SELECT path FROM known) AS "exists" FROM claims
             WHERE claim LIKE 'C:%' OR string_split(claim, '/')[2] IN (SELECT lang FROM known))"""


@query("", f"WITH {_CLAIMS} SELECT id, claim FROM claims")
def path_claims(spark, path):
    return v.path_facts(spark, path).select("id", F.explode(verify.claims("content")).alias("claim"))


@query(
    "",
    f"""WITH {_CLAIMS} SELECT t.id, CASE WHEN n IS NULL THEN 'unknown' WHEN lost = 0 THEN 'ok' ELSE 'stale' END AS verify_state
        FROM told t LEFT JOIN (SELECT id, count(*) AS n, count(*) FILTER (NOT "exists") AS lost FROM held GROUP BY id) h USING (id)""",
)
def facts_verified(spark, path):
    out = verify.verdicts(v.path_facts(spark, path), v.known_paths(spark, path))
    return out.select("id", "verify_state")


_TASK_SQL = """SELECT o_orderkey AS id, o_orderstatus AS mode, lower(CASE o_orderpriority
        WHEN '1-URGENT' THEN 'Redesign and migrate shipment ' || o_orderkey || ' unattended, overnight'
        WHEN '2-HIGH' THEN 'Investigate why shipment ' || o_orderkey || ' is late'
        WHEN '3-MEDIUM' THEN 'Rename the label of shipment ' || o_orderkey
        WHEN '5-LOW' THEN 'What does shipment ' || o_orderkey || ' contain'
        ELSE 'Build shipment ' || o_orderkey END
        || CASE o_orderstatus WHEN 'P' THEN repeat(' and then the next one', 5) ELSE '' END) AS t FROM orders"""
_TIER = f"""CASE WHEN regexp_matches(t, {_re(fixed.SIZING_LONG_RUN)}) AND regexp_matches(t, {_re(fixed.SIZING_DESIGNING)}) THEN 'hardest'
    WHEN regexp_matches(t, {_re(fixed.SIZING_DESIGNING)}) THEN 'deep'
    WHEN (regexp_matches(t, {_re(fixed.SIZING_MECHANICAL)}) OR regexp_matches(t, {_re(fixed.SIZING_EXPLAINING)}))
         AND len(list_filter(string_split(t, ' '), lambda w: w <> '')) <= 20 THEN 'light' ELSE 'deep' END"""


@query("", f"SELECT id, {_TIER} AS tier FROM ({_TASK_SQL})")
def task_sizing(spark, path):
    return v.task_texts(spark, path).select("id", rules.task_tier("task")["tier"].alias("tier"))


@query(
    "",
    f"""SELECT id, CASE WHEN mode = 'F' THEN CASE WHEN tier IN ('hardest', 'deep') THEN 'standard' ELSE tier END
                        WHEN mode = 'O' THEN 'standard' ELSE tier END AS tier,
               CASE WHEN mode = 'O' THEN 'the local model' ELSE 'rules' END AS "by"
        FROM (SELECT id, mode, {_TIER} AS tier FROM ({_TASK_SQL}))""",
)
def task_routing(spark, path):
    """Open orders carry a valid classifier reply, partial ones an invalid one, finished ones are read-only."""
    tasks = v.task_texts(spark, path)
    tasks = tasks.withColumn("reply", F.when(F.col("mode") == "O", " Standard | plain work").otherwise("perhaps tier 9"))
    tasks = tasks.withColumn("permission", F.when(F.col("mode") == "F", "read").otherwise("edit"))
    return rules.sized(tasks, "task", "reply", "permission").select("id", "tier", "by")


_VERDICT = """SELECT c_custkey AS id, CASE
        WHEN c_nationkey = 3 THEN 'forget' WHEN c_nationkey = 5 OR c_mktsegment = 'MACHINERY' THEN 'keep'
        WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'remove'
        WHEN floor(c_acctbal / 100) >= 14 AND c_mktsegment <> 'FURNITURE' AND c_nationkey > 0 THEN 'builds' ELSE 'keep' END AS action,
      CASE WHEN c_nationkey = 3 THEN 'worktree directory is gone'
        WHEN c_nationkey = 5 THEN 'uncommitted changes — never auto-removed'
        WHEN c_mktsegment = 'MACHINERY' THEN 'pinned (persistent worktree)'
        WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 1000 THEN 'nothing has been committed to it'
        WHEN c_mktsegment = 'BUILDING' THEN 'merged into main'
        WHEN c_mktsegment = 'HOUSEHOLD' THEN 'marked done 2024-01-05'
        WHEN floor(c_acctbal / 100) >= 14 AND c_mktsegment <> 'FURNITURE' AND c_nationkey > 0 THEN
             'no commits in ' || CAST(floor(c_acctbal / 100) AS INTEGER) || 'd, ' || c_nationkey || ' unmerged commit(s) kept'
        WHEN floor(c_acctbal / 100) >= 14 THEN 'stale (' || CAST(floor(c_acctbal / 100) AS INTEGER) || 'd) but nothing to reclaim'
        ELSE 'active' END AS why FROM customer"""


@query("", _VERDICT)
def stream_verdict(spark, path):
    return v.worktrees(spark, path).withColumn("_v", rules.stream_verdict()).select("id", "_v.action", "_v.why")


@query(
    "",
    """SELECT count(*) AS stories, CAST(sum(left(o_orderpriority, 1)::INT) AS BIGINT) AS criteria,
              count(*) FILTER (left(o_orderpriority, 1)::INT <= 2) AS declared,
              count(*) FILTER (left(o_orderpriority, 1)::INT > 2) AS undeclared,
              count(*) FILTER (left(o_orderpriority, 1)::INT > 2 AND o_orderstatus IN ('F', 'P')) AS unproven,
              count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS drifted FROM orders""",
)
def story_summary(spark, path):
    """Specifications parsed from markdown, judged against the files that exist."""
    stories = trace.specs(v.spec_files(spark, path))
    customers = v.table(spark, path, "customer").filter("c_acctbal > 0")
    paths = customers.select(F.concat(F.lit("src/"), F.col("c_custkey").cast("string"), F.lit(".js")).alias("path"))
    return trace.summary(trace.assess(stories, paths)).drop("failing", "passing")


@query(
    "",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order' AS title,
              CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in-review' ELSE 'ready' END AS status,
              left(o_orderpriority, 1)::INT AS criteria, CASE WHEN left(o_orderpriority, 1)::INT <= 2 THEN 'make check' ELSE '' END AS commands,
              'src/' || o_custkey || '.js' AS code_map FROM orders""",
)
def story_specs(spark, path):
    return trace.specs(v.spec_files(spark, path)).select(
        "id", "title", "status", F.size("criteria").alias("criteria"),
        F.array_join("commands", " ").alias("commands"), F.array_join("code_map", " ").alias("code_map"),
    )


@query(
    "commit_files symbols",
    """, built AS (SELECT service, 800000000 + max(node_id) AS at FROM symbols GROUP BY service),
       landed AS (SELECT c.*, split_part(c.file, '/', 1) AS service FROM commit_files c),
       unseen AS (SELECT l.* FROM landed l JOIN built b USING (service) WHERE l."at" > b.at)
       SELECT service, count(DISTINCT "commit") AS commits, count(DISTINCT file) AS files FROM unseen GROUP BY service""",
)
def staleness(spark, path):
    """Code commits each service's graph has not seen, and how many files they touch."""
    commits = v.commit_files(spark, path).withColumn("service", F.split("file", "/")[0])
    built = v.symbols(spark, path).groupBy("service").agg((F.lit(800000000) + F.max("node_id")).alias("built_at"))
    unseen = freshness.unseen_files(commits, built)
    return freshness.staleness(unseen).select("service", "commits", "files")


@query(
    "commit_files symbols",
    """, built AS (SELECT service, 800000000 + max(node_id) AS at FROM symbols GROUP BY service),
       unseen AS (SELECT DISTINCT split_part(c.file, '/', 1) AS service, c.file FROM commit_files c
                  JOIN built b ON b.service = split_part(c.file, '/', 1) WHERE c."at" > b.at)
       SELECT service, file FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY file) AS r FROM unseen) WHERE r <= 5""",
)
def stale_files(spark, path):
    commits = v.commit_files(spark, path).withColumn("service", F.split("file", "/")[0])
    built = v.symbols(spark, path).groupBy("service").agg((F.lit(800000000) + F.max("node_id")).alias("built_at"))
    return freshness.named_files(freshness.unseen_files(commits, built), 5).select("service", "file")


@query(
    "",
    """SELECT page_id, CASE WHEN b > 1e9 THEN printf('%.1f GB', b / 1e9) WHEN b > 1e6 THEN printf('%.0f MB', b / 1e6)
              ELSE printf('%.0f KB', b / 1e3) END AS size
       FROM (SELECT page_id, CAST(length(html) AS DOUBLE) * 1237 AS b FROM pages)""",
)
def human_bytes(spark, path):
    size = F.length("html").cast("double") * 1237
    return v.table(spark, path, "pages").select("page_id", tx.human_bytes(size).alias("size"))
