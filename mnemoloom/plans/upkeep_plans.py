"""What keeps an index and a memory current: drift, re-verification, check output, briefs; and the wider word search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import explore, extract, freshness, graph, lexical, projects, rules, symbols as sym, verify
from ..operators.ordering import top_per
from ..sources import views as v
from .dialect import sql_tokens
from .registry import query
from .retrieval_plans import _DEGREES, _LEXICAL_QUESTIONS, _LEXICAL_SQL, _asked, _degrees
from .rules_plans import _CLAIM_TEXT, _FAIL, _SUM, _VERDICT, _re


# Drift ----------------------------------------------------------------------
_UNSEEN = """, built AS (SELECT service, 800000000 + max(node_id) AS at FROM symbols GROUP BY service),
       unseen AS (SELECT b.service, c."commit", c.file FROM commit_files c JOIN built b ON b.service = split_part(c.file, '/', 1) WHERE c."at" > b.at)"""


def _unseen(spark, path):
    commits = v.commit_files(spark, path).withColumn("service", F.split("file", "/")[0])
    built = v.symbols(spark, path).groupBy("service").agg((F.lit(800000000) + F.max("node_id")).alias("built_at"))
    return freshness.unseen_files(commits, built)


@query(
    "commit_files symbols",
    f"""{_UNSEEN}, per AS (SELECT service, count(DISTINCT "commit") AS commits FROM unseen GROUP BY service)
       SELECT count(*) > 0 AS stale, CAST(coalesce(sum(commits), 0) AS BIGINT) AS commits, string_agg(service, ' ' ORDER BY service) AS behind FROM per""",
)
def project_staleness(spark, path):
    services = v.symbols(spark, path).select("service").distinct()
    out = freshness.project_staleness(services, _unseen(spark, path))
    return out.select("stale", "commits", F.array_join("behind", " ").alias("behind"))


@query(
    "commit_files symbols",
    """, repos AS (SELECT service, 800000000 + max(node_id) AS at, left(md5(service), 7) AS built,
                          CASE max(node_id) % 3 WHEN 0 THEN md5(service) WHEN 1 THEN md5('x' || service) END AS head,
                          CASE max(node_id) % 5 WHEN 0 THEN 0 WHEN 1 THEN 41 WHEN 2 THEN 3 WHEN 3 THEN 40 END AS behind FROM symbols GROUP BY service),
       moved AS (SELECT * FROM repos WHERE NOT coalesce(starts_with(head, built), false) AND behind IS DISTINCT FROM 0),
       unseen AS (SELECT DISTINCT service, c.file FROM commit_files c JOIN moved ON service = split_part(c.file, '/', 1)
                  WHERE c."at" > moved.at AND coalesce(behind, 0) <= 40),
       named AS (SELECT service, count(*) AS total, string_agg(file, ', ' ORDER BY file) FILTER (r <= 5) AS files
                 FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY file) AS r FROM unseen) GROUP BY service)
       SELECT service, CASE WHEN total IS NULL THEN '- ' || service || ': index older than the tree by ' || behind || ' commits; needs a rebuild'
                            ELSE '- ' || service || ': changed since the index was built (' || total || '): ' || files
                                 || CASE WHEN total > 5 THEN ' + ' || (total - 5) ELSE '' END END AS line
       FROM moved LEFT JOIN named USING (service) WHERE coalesce(behind > 40, false) OR total > 0""",
)
def drift_sentences(spark, path):
    """What a session is told about repositories behind their code: current, unknown, near and far ones."""
    newest = v.symbols(spark, path).groupBy("service").agg(F.max("node_id").alias("m"))
    repos = newest.select(
        "service", F.substring(F.md5("service"), 1, 7).alias("built"),
        F.when(F.col("m") % 3 == 0, F.md5("service")).when(F.col("m") % 3 == 1, F.md5(F.concat(F.lit("x"), "service"))).alias("head"),
        F.when(F.col("m") % 5 == 0, 0).when(F.col("m") % 5 == 1, 41).when(F.col("m") % 5 == 2, 3).when(F.col("m") % 5 == 3, 40).alias("behind"),
    )
    return freshness.sentences(freshness.changed_code(repos, _unseen(spark, path)))


@query(
    "commit_files symbols",
    f"""{_UNSEEN}, named AS (SELECT DISTINCT service || '/' || file AS name FROM unseen),
       top AS (SELECT name FROM named ORDER BY name LIMIT 24)
       SELECT total, 'not in the index (' || total || ' changed files): ' || (SELECT string_agg(name, ', ' ORDER BY name) FROM top)
              || CASE WHEN total > 24 THEN ' + ' || (total - 24) ELSE '' END AS line FROM (SELECT count(*) AS total FROM named) WHERE total > 0""",
)
def drift_header(spark, path):
    return projects.drift_header(_unseen(spark, path))


# Facts that name paths ------------------------------------------------------
# Claims in the order a text names them, each once, with what became of them.
_CHECKED = f"""
    told AS ({_CLAIM_TEXT}),
    listed AS (SELECT id, list_transform(list_concat(regexp_extract_all(content, {_re(fixed.WINDOWS_PATH)}),
        regexp_extract_all(content, {_re(fixed.POSIX_PATH)}, 1)), lambda p: regexp_replace(p, {_re(fixed.CLAIM_TRAILING)}, '')) AS l FROM told),
    placed AS (SELECT id, claim, min(p) AS p FROM (SELECT id, unnest(l) AS claim, unnest(range(len(l))) AS p FROM listed)
        WHERE length(claim) >= 4 AND NOT regexp_matches(claim, {_re(fixed.CLAIM_PLACEHOLDER)}) AND NOT regexp_matches(claim, {_re(fixed.CLAIM_URL)})
          AND len(list_filter(string_split_regex(claim, '[\\\\/]+'), lambda s: s <> '')) >= 2 GROUP BY id, claim),
    known AS (SELECT DISTINCT '/' || lang || '/' || doc_id AS path, lang FROM documents),
    held AS (SELECT id, p, claim, claim IN (SELECT path FROM known) AS there FROM placed
             WHERE claim LIKE 'C:%' OR string_split(claim, '/')[2] IN (SELECT lang FROM known)),
    summed AS (SELECT id, count(*) AS n, list(claim ORDER BY p) FILTER (NOT there) AS lost FROM held GROUP BY id),
    judged AS (SELECT t.id, CASE WHEN n IS NULL THEN 'unknown' WHEN lost IS NULL THEN 'ok' ELSE 'stale' END AS verify_state,
                      CASE WHEN n IS NULL THEN 'names no path' WHEN lost IS NULL THEN n || ' paths found'
                           ELSE 'not found: ' || array_to_string(lost[1:2], ', ') || CASE WHEN len(lost) > 2 THEN ' (+' || (len(lost) - 2) || ' more)' ELSE '' END END AS verify_note
               FROM told t LEFT JOIN summed USING (id))"""


@query(
    "",
    f"""WITH {_CHECKED} SELECT id, CASE WHEN id % 5 = 0 THEN 'unset' ELSE verify_state END AS verify_state,
               CASE WHEN id % 5 = 0 THEN 'before' ELSE verify_note END AS verify_note FROM judged""",
)
def facts_reverified(spark, path):
    """Every live fact checked again; superseded ones keep the verdict they had."""
    old = v.path_facts(spark, path).select(
        "id", "content", F.when(F.col("id") % 5 == 0, F.col("id") + 1).alias("superseded_by"),
        F.lit("unset").alias("verify_state"), F.lit("before").alias("verify_note"),
    )
    return verify.reverify(old, v.known_paths(spark, path)).select("id", "verify_state", "verify_note")


@query(
    "",
    f"""WITH {_CHECKED}, gone AS (SELECT * FROM judged WHERE verify_state = 'stale')
        SELECT id, verify_state, verify_note, (SELECT count(*) FROM gone) AS total FROM gone ORDER BY id LIMIT 3""",
)
def facts_drifted(spark, path):
    return verify.drifted(v.path_facts(spark, path), v.known_paths(spark, path)).select("id", "verify_state", "verify_note", "total")


@query(
    "facts",
    f""", {_CHECKED} SELECT id, md5(content) AS content, verify_state FROM facts
        UNION ALL SELECT (SELECT max(id) FROM facts) + row_number() OVER (ORDER BY content), md5(content), verify_state FROM told JOIN judged USING (id)""",
)
def facts_saved(spark, path):
    """New facts under new ids, checked as they are written."""
    new = v.path_facts(spark, path).withColumn("kind", F.lit("fact"))
    saved = verify.save_facts(v.facts(spark, path), new, v.known_paths(spark, path))
    return saved.select("id", F.md5(F.col("content").cast("binary")).alias("content"), "verify_state")


# Output of checks -----------------------------------------------------------
def _context(rows: str, keys: str) -> str:
    same = " AND ".join(f"l.{k} = t.{k}" for k in keys.split())
    columns = ", ".join(f"l.{k}" for k in keys.split())
    return f"""ctx AS (SELECT DISTINCT {columns}, l.n FROM {rows} l JOIN top t ON {same} AND l.n IN (t.n + 1, t.n + 2)
                       WHERE regexp_matches(l.text, {_re(fixed.CONTEXT_PATTERN)}) AND trim(l.text) <> '')"""


@query(
    "log_lines",
    f""", fine AS (SELECT n // 9 AS run, n, text FROM log_lines),
        top AS (SELECT run, n FROM (SELECT run, n, row_number() OVER (PARTITION BY run ORDER BY n) AS r FROM fine WHERE {_FAIL}) WHERE r <= 2),
        {_context('fine', 'run')},
        silent AS (SELECT run FROM fine GROUP BY run HAVING NOT bool_or({_FAIL} OR {_SUM}) AND run % 3 <> 0),
        last AS (SELECT run, n, text, row_number() OVER (PARTITION BY run ORDER BY n DESC) AS r FROM fine JOIN silent USING (run) WHERE text <> '')
        SELECT run, n, text FROM fine WHERE (run, n) IN (FROM top) OR (run, n) IN (FROM ctx) OR (NOT {_FAIL} AND {_SUM})
        UNION ALL SELECT run, n, text FROM last WHERE r <= 5""",
)
def log_rendered(spark, path):
    """Runs of three events: what a reader gets of each, the tail where a failing run says nothing recognised."""
    lines = v.log_lines(spark, path).withColumn("run", F.expr("n div 9"))
    runs = lines.select("run", F.when(F.col("run") % 3 == 0, 0).otherwise(1).alias("code")).distinct()
    return extract.rendered(lines, runs, max_failures=2, last=5)


@query(
    "log_lines",
    f""", fine AS (SELECT n // 18 AS run, n, text, CAST(n // 3 % 2 AS INTEGER) AS place FROM log_lines),
        f AS (SELECT run, place, n, row_number() OVER (PARTITION BY run, place ORDER BY n) AS r FROM fine WHERE {_FAIL}),
        spent AS (SELECT run, count(*) AS used FROM f WHERE place = 0 GROUP BY run),
        top AS (SELECT run, place, n FROM f LEFT JOIN spent USING (run) WHERE r <= CASE place WHEN 0 THEN 2 ELSE greatest(2 - coalesce(used, 0), 0) END),
        {_context('fine', 'run place')}
        SELECT run, place, n, CASE WHEN (run, place, n) IN (FROM top) THEN 'failure' WHEN NOT {_FAIL} AND {_SUM} THEN 'summary' ELSE 'context' END AS reason
        FROM fine WHERE (run, place, n) IN (FROM top) OR (run, place, n) IN (FROM ctx) OR (NOT {_FAIL} AND {_SUM})""",
)
def check_assembly(spark, path):
    """Runs of six events on two streams: stderr first, stdout with what is left of the cap."""
    lines = v.log_lines(spark, path).withColumn("run", F.expr("n div 18"))
    lines = lines.withColumn("stream", F.when(F.expr("n div 3") % 2 == 0, "stderr").otherwise("stdout"))
    return extract.check_lines(lines, max_failures=2).select("run", "place", "n", "reason")


@query("log_lines", "SELECT run, n, text FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC) AS r FROM log_lines) WHERE r <= 400")
def session_tail(spark, path):
    return extract.raw_tail(v.log_lines(spark, path))


# Projects -------------------------------------------------------------------
_STATUS = """status AS (SELECT c_custkey // 2 AS stream, CASE c_mktsegment WHEN 'BUILDING' THEN '?? target/out.o' WHEN 'MACHINERY' THEN ' M src/main.rs'
    WHEN 'HOUSEHOLD' THEN '?? "notes.txt"' WHEN 'FURNITURE' THEN ' M target/kept.rs' ELSE '' END AS line FROM customer)"""


@query("", f"WITH {_STATUS} SELECT stream, bool_or(NOT starts_with(line, '?? target')) AS dirty FROM status WHERE line <> '' GROUP BY stream")
def streams_dirty(spark, path):
    """Status lines of streams: untracked output of a build is not work at risk, tracked files under it are."""
    seg = F.col("c_mktsegment")
    line = (
        F.when(seg == "BUILDING", "?? target/out.o").when(seg == "MACHINERY", " M src/main.rs")
        .when(seg == "HOUSEHOLD", '?? "notes.txt"').when(seg == "FURNITURE", " M target/kept.rs").otherwise("")
    )
    return rules.dirty_streams(v.table(spark, path, "customer").select(F.expr("c_custkey div 2").alias("stream"), line.alias("line")))


# Nations are the projects; each has streams (customers), tasks (their orders) and a share of the symbols.
_PROJECTS = f"""
    streams AS (SELECT c_nationkey AS repo, action FROM customer JOIN ({_VERDICT}) ON id = c_custkey),
    tasks AS (SELECT c_nationkey AS repo, o_orderkey AS id, o_orderdate AS "at" FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'),
    indexed AS (SELECT p_partkey % 25 AS repo, count(*) AS symbols, max(p_partkey) AS m FROM part WHERE p_partkey % 25 <> 7 GROUP BY 1)"""


def _projects(spark, path):
    nation = v.table(spark, path, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("repo"))
    streams = v.worktrees(spark, path).withColumn("action", rules.stream_verdict()["action"]).select("id", "action").join(nation, "id")
    tasks = v.tasks(spark, path).join(nation.withColumnRenamed("id", "_c").withColumnRenamed("repo", "_r"), F.col("repo") == F.col("_c"))
    tasks = tasks.select("id", "title", F.col("_r").alias("repo"), "state", "updated_at")
    indexed = v.symbols(spark, path).groupBy((F.col("node_id") % 25).alias("repo")).agg(F.count(F.lit(1)).alias("symbols"), F.max("node_id").alias("m"))
    listed = v.table(spark, path, "nation").select(F.col("n_nationkey").alias("path"))
    return listed, streams, tasks, indexed.filter("repo <> 7")


@query(
    "",
    f"""WITH {_PROJECTS} SELECT n_nationkey AS path, (SELECT count(*) FROM streams WHERE repo = n_nationkey) AS streams,
          (SELECT count(*) FROM tasks WHERE repo = n_nationkey) AS tasks,
          coalesce((SELECT symbols FROM indexed WHERE repo = n_nationkey), 0) AS symbols, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS checks
        FROM nation""",
)
def project_cards(spark, path):
    listed, streams, tasks, indexed = _projects(spark, path)
    checks = listed.filter("path % 2 = 0").select(F.col("path").alias("repo"), F.lit("test").alias("name"))
    return projects.cards(listed, streams, tasks, indexed.select("repo", "symbols"), checks)


@query(
    "",
    f"""WITH {_PROJECTS},
        newest AS (SELECT repo, string_agg(id, ' ' ORDER BY "at" DESC, id DESC) AS ids
                   FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY "at" DESC, id DESC) AS r FROM tasks) WHERE r <= 3 GROUP BY repo)
        SELECT n_nationkey AS path, coalesce(symbols, 0) AS symbols, CASE WHEN m % 3 = 1 THEN NULL WHEN symbols IS NOT NULL THEN m % 3 = 0 END AS current,
               (SELECT count(*) FROM streams WHERE repo = n_nationkey) AS streams,
               (SELECT count(*) FROM streams WHERE repo = n_nationkey AND action IN ('remove', 'forget')) AS removable,
               (SELECT count(*) FROM tasks WHERE repo = n_nationkey) AS open_tasks, coalesce(ids, '') AS newest
        FROM nation LEFT JOIN indexed ON indexed.repo = n_nationkey LEFT JOIN newest ON newest.repo = n_nationkey""",
)
def project_brief(spark, path):
    """A line per project: what is indexed and whether it is current, its streams, and the tasks touched last."""
    listed, streams, tasks, indexed = _projects(spark, path)
    same = F.when(F.col("m") % 3 == 0, F.lit("c0ffee12")).when(F.col("m") % 3 == 2, F.lit("0ddba11"))
    indexed = indexed.select("repo", "symbols", F.lit("c0ffee1").alias("built"), same.alias("head"))
    out = projects.brief(listed, indexed, streams, tasks, shown=3)
    newest = F.array_join(F.transform("newest", lambda t: t["id"].cast("string")), " ")
    return out.withColumn("newest", newest)


@query(
    "symbols edges",
    """, repos AS (SELECT service, count(*) AS symbols FROM symbols WHERE callable GROUP BY service),
       calls AS (SELECT count(*) AS n FROM edges JOIN symbols ON node_id = src WHERE callable)
       SELECT count(*) AS services, CAST(sum(symbols) AS BIGINT) AS symbols, (SELECT n FROM calls) AS edges FROM repos HAVING count(*) > 0""",
)
def graph_summary(spark, path):
    """Totals over the indexed services."""
    symbols = v.symbols(spark, path)
    edges = graph.valid_edges(v.links(spark, path), symbols)
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    repos = symbols.filter("callable").join(out, "node_id", "left").groupBy(F.col("service").alias("repo")).agg(
        F.count(F.lit(1)).alias("symbols"), F.sum(F.coalesce("n", F.lit(0))).alias("edges"), F.lit(None).cast("timestamp").alias("imported_at")
    )
    services = symbols.select(F.col("service").alias("name"), F.col("service").alias("path")).distinct()
    return explore.graph_summary(explore.service_status(services, repos)).drop("imported_at")


@query(
    "",
    """WITH items AS (SELECT p_brand AS "group", p_partkey AS position, p_partkey AS id, p_name AS label, CASE WHEN p_size % 3 <> 0 THEN p_type END AS needs,
                             p_partkey + 1 AS "then" FROM part),
         runs AS (SELECT * FROM items WHERE needs IS NULL OR needs IN (SELECT p_type FROM part WHERE p_type LIKE 'S%'))
       SELECT r."group", r.position, r.id, r.label, r.needs, f.label AS "next" FROM runs r LEFT JOIN runs f ON r."then" = f.id""",
)
def menu_items(spark, path):
    """Parts as items of menus: those that need nothing or what is installed, each naming a follow-up that runs too."""
    part = v.table(spark, path, "part")
    items = part.select(
        F.col("p_brand").alias("group"), F.col("p_partkey").alias("position"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("needs"), (F.col("p_partkey") + 1).alias("then"),
    )
    return rules.menu(items, part.filter("p_type like 'S%'").select(F.col("p_type").alias("name")))


# Words ----------------------------------------------------------------------
_GUESSES = [(0, "polished"), (0, "bolts"), (1, "small"), (1, "widget"), (2, "ring"), (2, "blue")]
_GUESSED_SQL = f"""
    guessed AS (SELECT qid, string_agg(text, ' ') AS text FROM (VALUES {', '.join(f"({q}, '{t}')" for q, t in _GUESSES)}) t(qid, text) GROUP BY qid),
    hints AS (SELECT qid, len(t) AS asked, unnest(t) AS term FROM (SELECT qid, list_distinct({sql_tokens('text')}) AS t FROM guessed)),
    hinted AS (SELECT qid, node_id, sum(weight) * (1 + count(*) / any_value(asked)) * CAST(0.8 AS DOUBLE) AS score
               FROM best JOIN hints USING (term) GROUP BY qid, node_id),
    either AS (SELECT qid, node_id, max(score) AS score FROM (SELECT qid, node_id, score FROM lexical UNION ALL FROM hinted) GROUP BY qid, node_id)"""


@query(
    "symbols edges",
    f""", {_LEXICAL_SQL}, {_GUESSED_SQL}, {_DEGREES},
        reached AS (SELECT qid, node_id, score + 0.05 * least(coalesce(degree, 0), 6) AS score FROM either LEFT JOIN degrees USING (node_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node_id) AS rank FROM reached)
        SELECT qid, node_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""",
)
def lexical_guessed(spark, path):
    """Own words of a question or words guessed for it, whichever says more of a symbol."""
    guesses = spark.createDataFrame(_GUESSES, "qid int, text string")
    scored = lexical.with_guesses(v.symbols(spark, path), _asked(spark), guesses)
    reached = lexical.with_reach(scored, _degrees(spark, path))
    top = top_per(reached, ["qid"], [F.round("score", 9).desc(), F.col("node_id")], 6)
    return top.select("qid", "node_id", F.round("score", 6).alias("score"), "rank")


@query(
    "symbols edges",
    f""", asked AS (SELECT list_distinct({sql_tokens(f"'{_LEXICAL_QUESTIONS[0]}'")}) AS t),
        bare AS (SELECT node_id, unnest({sql_tokens('label')}) AS term, 8 AS weight FROM symbols UNION ALL SELECT node_id, unnest({sql_tokens('file')}), 1 FROM symbols),
        best AS (SELECT node_id, term, max(weight) AS weight FROM bare GROUP BY ALL),
        found AS (SELECT node_id, sum(weight) * (1 + count(*) / any_value(len(t))) AS score FROM best, asked WHERE list_contains(t, term) GROUP BY node_id),
        called AS (SELECT dst AS node_id, count(*) AS n FROM edges GROUP BY dst)
        SELECT node_id, round(score, 6) AS score FROM (SELECT node_id, score + 0.1 * least(coalesce(n, 0), 5) AS score FROM found LEFT JOIN called USING (node_id))
        ORDER BY score DESC, node_id LIMIT 6""",
)
def symbol_find(spark, path):
    """By names and paths alone, callers breaking ties."""
    symbols = v.symbols(spark, path)
    found = sym.find_by_name(symbols, graph.valid_edges(v.links(spark, path), symbols), _LEXICAL_QUESTIONS[0])
    return found.select("node_id", F.round("score", 6).alias("score"))
