"""Words, vectors and their combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import evaluate, fulltext, fusion, lexical, memory, recall
from ..operators.ordering import top_per
from ..session import spread, stored
from ..sources import views as v
from .dialect import sql_bm25, sql_index_tokens, sql_keyword_terms, sql_stem, sql_tokens, sql_words
from .registry import query

_FACT_TOKENS = f"list_concat({sql_index_tokens('content')}, {sql_index_tokens('context')})"
_SCENARIOS = """ "scenarios" AS (SELECT url AS path, regexp_extract(url, '://([^/]+)', 1) AS summary, html AS content
                                 FROM pages)"""
_SCENARIO_TOKENS = (
    f"list_concat(list_concat({sql_index_tokens('path')}, {sql_index_tokens('summary')}), {sql_index_tokens('content')})"
)


def _scenarios(spark, path):
    host = F.regexp_extract("url", "://([^/]+)", 1)
    pages = spread(v.table(spark, path, "pages").select("page_id", "url", "html"), "page_id")
    return pages.select(F.col("url").alias("path"), host.alias("summary"), F.col("html").alias("content"))


def _questions(spark, path):
    """Every benchmark text as a question, with the vector of the same id."""
    vectors = v.vectors(spark, path).select(F.col("id").alias("qid"), "embedding")
    return v.questions(spark, path).join(vectors, "qid", "left")


def _facts(spark, path):
    return v.facts(spark, path).join(v.vectors(spark, path).select("id", "embedding"), "id", "left")


# Words ----------------------------------------------------------------------
@query(
    "facts",
    f"SELECT term, count(*) AS uses FROM (SELECT unnest({sql_tokens('content')}) AS term FROM facts) GROUP BY term",
)
def tokens_frequency(spark, path):
    terms = v.facts(spark, path).select(F.explode(tx.tokens("content")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))


@query(
    "turns",
    f"""SELECT DISTINCT word, {sql_stem('word')} AS stem
        FROM (SELECT unnest({sql_words('content')}) AS word FROM turns)""",
)
def stem_terms(spark, path):
    found = v.turns(spark, path).select(F.explode(tx.words("content")).alias("word")).distinct()
    return found.select("word", tx.stem("word").alias("stem"))


@query(
    "questions",
    f"SELECT qid, array_to_string(list_sort(list_distinct({sql_tokens('text')})), ' ') AS terms FROM questions",
)
def query_terms(spark, path):
    sorted_terms = F.array_sort(tx.query_terms("text"))
    return v.questions(spark, path).select("qid", F.array_join(sorted_terms, " ").alias("terms"))


@query(
    "questions",
    f"SELECT qid, array_to_string({sql_keyword_terms('text')}, ' ') AS terms FROM questions",
)
def keyword_query(spark, path):
    return v.questions(spark, path).select("qid", F.array_join(tx.keyword_terms("text"), " ").alias("terms"))


@query(
    "facts",
    f"""SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM (
          SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_FACT_TOKENS}) AS term FROM facts) GROUP BY ALL)
        GROUP BY term""",
)
def postings_summary(spark, path):
    index = fulltext.postings(v.facts(spark, path), "id", ["content", "context"])
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("uses"))


_LEXICAL_QUESTIONS = ["where is the small blue ring handled", "which tests reach standard gears", "economy bolts"]
_LEXICAL_SQL = f"""
    asked AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{q}')" for i, q in enumerate(_LEXICAL_QUESTIONS))}) t(qid, text)),
    fields AS (
        SELECT node_id, unnest({sql_tokens('label')}) AS term, 8.0 AS weight FROM symbols
        UNION ALL SELECT node_id, unnest({sql_tokens('doc')}), 3.0 FROM symbols
        UNION ALL SELECT node_id, unnest({sql_tokens('file')}), 1.0 FROM symbols),
    best AS (SELECT node_id, term, CAST(max(weight) AS DOUBLE) AS weight FROM fields GROUP BY ALL),
    terms AS (SELECT qid, len(t) AS asked, unnest(t) AS term
              FROM (SELECT qid, list_distinct({sql_tokens('text')}) AS t FROM asked)),
    lexical AS (SELECT qid, node_id, sum(weight) * (1 + count(*) / any_value(asked)) AS score, count(*) AS matched
                FROM best JOIN terms USING (term) GROUP BY qid, node_id)"""


def _asked(spark):
    return spark.createDataFrame(list(enumerate(_LEXICAL_QUESTIONS)), "qid int, text string")


@query("symbols", f", {_LEXICAL_SQL} SELECT qid, node_id, round(score, 6) AS score, matched FROM lexical")
def lexical_score(spark, path):
    return lexical.scores(v.symbols(spark, path), _asked(spark)).withColumn("score", F.round("score", 6))


_DEGREES = """
    degrees AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges)
                GROUP BY node_id)"""


def _degrees(spark, path):
    from ..operators import graph

    symbols = v.symbols(spark, path)
    return graph.degree(graph.valid_edges(v.links(spark, path), symbols))


@query(
    "symbols edges",
    f""", {_LEXICAL_SQL}, {_DEGREES},
        reached AS (SELECT qid, node_id, score + 0.05 * least(coalesce(degree, 0), 6) AS score
                    FROM lexical LEFT JOIN degrees USING (node_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM reached)
        SELECT qid, node_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""",
)
def lexical_topk(spark, path):
    scored = lexical.with_guesses(v.symbols(spark, path), _asked(spark))
    reached = lexical.with_reach(scored, _degrees(spark, path))
    top = top_per(reached, ["qid"], [F.col("score").desc(), F.col("node_id")], 6)
    return top.select("qid", "node_id", F.round("score", 6).alias("score"), "rank")


@query(
    "symbols",
    f"""SELECT node_id, CAST(len(t) AS BIGINT) AS terms,
               len(list_filter(t, lambda x: list_contains(own, x))) AS own_hits,
               len(list_filter(t, lambda x: list_contains(own, x) OR list_contains(ctx, x))) AS module_hits
        FROM (SELECT node_id, list_distinct({sql_tokens("'tests for the small Blue ring in ' || service")}) AS t,
                     list_concat(list_concat({sql_tokens('label')}, {sql_tokens('file')}), {sql_tokens('doc')}) AS own,
                     {sql_tokens('service')} AS ctx FROM symbols)""",
)
def vocabulary_overlap(spark, path):
    symbols = v.symbols(spark, path).withColumn("context", F.col("service"))
    text = F.concat(F.lit("tests for the small Blue ring in "), "service")
    pairs = symbols.select(F.col("node_id").alias("qid"), text.alias("text"), "node_id")
    return lexical.overlap(symbols, pairs).select("node_id", "terms", "own_hits", "module_hits")


# BM25 -----------------------------------------------------------------------
_BM25 = sql_bm25("facts", "id", _FACT_TOKENS, "questions", "bm")


@query(
    "facts questions",
    f""", {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS rank FROM bm)
        SELECT qid, k AS id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def bm25_topk(spark, path):
    top = fulltext.bm25_top(v.facts(spark, path), v.questions(spark, path), "id", ["content", "context"], 10)
    return top.select("qid", "id", F.round("score", 6).alias("score"), "rank")


_KEYWORD_LEGS = f"""
    {_BM25}, {_SCENARIOS}, {sql_bm25('scenarios', 'path', _SCENARIO_TOKENS, 'questions', 'bs')},
    {sql_bm25('turns', 'id', sql_index_tokens('content'), 'questions', 'bt')},
    keyword AS (
        SELECT qid, leg, CAST(rank AS INTEGER) AS rank, key FROM (
            SELECT qid, 1 AS leg, 'L1:' || k AS key, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS rank
            FROM bm WHERE k NOT IN (SELECT id FROM facts WHERE superseded_by IS NOT NULL)
            UNION ALL SELECT qid, 2, 'L2:' || k, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) FROM bs
            UNION ALL SELECT qid, 3, 'L0:' || k, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) FROM bt)
        WHERE rank <= 16)"""


@query("facts turns questions", f", {_KEYWORD_LEGS} SELECT * FROM keyword")
def recall_keyword(spark, path):
    return fulltext.keyword_recall(
        v.questions(spark, path), v.facts(spark, path), _scenarios(spark, path), v.turns(spark, path)
    )


_TRUTH = "truth AS (SELECT qid, f.id FROM questions q JOIN facts f ON contains(f.content, q.text))"


@query("facts questions", f", {_TRUTH} SELECT * FROM truth")
def question_truth(spark, path):
    return evaluate.containing(v.facts(spark, path), v.questions(spark, path))


@query(
    "facts questions",
    f""", {_BM25}, {_TRUTH},
        r AS (SELECT qid, k AS id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS rank FROM bm),
        best AS (SELECT t.qid, min(r.rank) AS rank
                 FROM truth t LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r ON r.qid = t.qid AND r.id = t.id
                 GROUP BY t.qid)
        SELECT count(*) AS questions, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 3) AS hit_3,
               count(*) FILTER (rank <= 5) AS hit_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM best""",
)
def retrieval_metrics(spark, path):
    facts, questions = v.facts(spark, path), v.questions(spark, path)
    hits = fulltext.bm25_top(facts, questions, "id", ["content", "context"], 5)
    out = evaluate.metrics(hits, evaluate.containing(facts, questions))
    return out.withColumn("mrr", F.round("mrr", 6))


# Vectors --------------------------------------------------------------------
_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


@query(
    "vectors",
    f"""SELECT id, label, round({_DOT.format('embedding', '(SELECT embedding FROM vectors WHERE id = 0)')}, 6) AS score
        FROM vectors ORDER BY score DESC, id LIMIT 16""",
)
def cosine_topk(spark, path):
    """The vectors closest to vector 0, itself included."""
    vectors = v.vectors(spark, path)
    asked = vectors.filter("id = 0").select("embedding").scalar()
    scored = vectors.withColumn("asked", asked)
    scored = scored.select("id", "label", F.round(vx.dot("embedding", "asked"), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(16)


@query(
    "facts vectors",
    f""", fv AS (SELECT f.id, embedding FROM facts f JOIN vectors v ON f.id = v.id WHERE superseded_by IS NULL),
        newest AS (SELECT id, embedding FROM fv ORDER BY id DESC LIMIT 1)
        SELECT fv.id, round({_DOT.format('fv.embedding', 'newest.embedding')}, 6) AS score FROM fv, newest
        WHERE fv.id <> newest.id AND score >= 0.1 ORDER BY score DESC, fv.id LIMIT 3""",
)
def supersede_candidates(spark, path):
    """What the newest fact with a vector may replace."""
    facts = memory.live(_facts(spark, path)).filter("embedding is not null").select("id", "embedding")
    newest = facts.orderBy(F.col("id").desc()).limit(1)
    out = memory.supersede_candidates(facts, newest, threshold=0.1)
    return out.select("id", F.round("score", 6).alias("score"))


_SEMANTIC = f"""
    sem AS (SELECT node_id, {_DOT.format('embedding', '(SELECT embedding FROM vectors WHERE id = 1)')}
                     * CASE WHEN callable THEN 1 ELSE 0.88 END + least(coalesce(degree, 0), 6) * 0.004 AS score
            FROM symbols JOIN vectors ON node_id = id LEFT JOIN degrees USING (node_id))"""


def _semantic(spark, path):
    from ..operators import symbols as sym

    vectors = v.vectors(spark, path)
    asked = vectors.filter("id = 1").select("embedding").scalar()
    rows = v.symbols(spark, path).join(vectors.select(F.col("id").alias("node_id"), "embedding"), "node_id")
    return sym.semantic_scores(rows, _degrees(spark, path), asked)


@query("symbols edges vectors", f", {_DEGREES}, {_SEMANTIC} SELECT node_id, round(score, 6) AS score FROM sem")
def symbol_semantic_score(spark, path):
    return _semantic(spark, path).select("node_id", F.round("score", 6).alias("score"))


@query(
    "symbols edges vectors",
    f""", {_DEGREES}, {_SEMANTIC}, {_LEXICAL_SQL},
        sr AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM sem),
        lr AS (SELECT node_id, row_number() OVER (ORDER BY score + 0.05 * least(coalesce(degree, 0), 6) DESC, node_id)
                 AS rank FROM lexical LEFT JOIN degrees USING (node_id) WHERE qid = 0),
        parts AS (SELECT node_id, 1.0::DOUBLE / (60 + rank) AS part, score AS cosine FROM sr
                  UNION ALL SELECT node_id, 0.7::DOUBLE / (60 + rank), NULL FROM lr)
        SELECT node_id, round(sum(part), 6) AS score, round(max(cosine), 6) AS cosine FROM parts GROUP BY node_id
        ORDER BY sum(part) DESC, node_id LIMIT 20""",
)
def rrf_fusion(spark, path):
    """Symbols for one question: semantic and lexical lists merged by position."""
    asked = _asked(spark).filter("qid = 0")
    words = lexical.with_reach(lexical.with_guesses(v.symbols(spark, path), asked), _degrees(spark, path))
    fused = fusion.fused_top(stored(_semantic(spark, path)), stored(words.select("node_id", "score")), 20)
    return fused.select("node_id", F.round("score", 6).alias("score"), F.round("cosine", 6).alias("cosine"))


# Recall ---------------------------------------------------------------------
_CANDIDATES = f"""
    {_KEYWORD_LEGS},
    fv AS (SELECT f.id, embedding FROM facts f JOIN vectors v ON f.id = v.id WHERE superseded_by IS NULL),
    semantic AS (SELECT qid, 0 AS leg, CAST(rank AS INTEGER) AS rank, 'L1:' || id AS key FROM (
        SELECT q.qid, fv.id, row_number() OVER (PARTITION BY q.qid
                   ORDER BY {_DOT.format('fv.embedding', 'qv.embedding')} DESC, 'L1:' || fv.id) AS rank
        FROM questions q JOIN vectors qv ON qv.id = q.qid, fv) WHERE rank <= 16),
    ordered AS (SELECT qid, key, min(leg) AS leg, arg_min(rank, leg) AS rank
                FROM (SELECT * FROM semantic UNION ALL SELECT * FROM keyword) GROUP BY qid, key)"""


@query("facts vectors turns questions", f", {_CANDIDATES} SELECT qid, key, leg, rank FROM ordered")
def recall_candidates(spark, path):
    return recall.candidates(
        _questions(spark, path), _facts(spark, path), _scenarios(spark, path), v.turns(spark, path)
    )


@query(
    "facts vectors turns questions",
    f"""RECURSIVE , {_CANDIDATES},
        shown AS (
            SELECT 'L1:' || f.id AS key, length('[L1:' || f.id || '] (' || kind || ' @' || context ||
                     CASE WHEN verify_state = 'stale' THEN ' !stale: ' ELSE '' END || ') ' || content) AS chars
            FROM facts f
            UNION ALL SELECT 'L2:' || path, length('[L2:' || path || '] (scenario @' || summary || ') ' || substr(content, 1, 1200))
            FROM scenarios
            UNION ALL SELECT 'L0:' || id, length('[L0:' || id || '] (' || role || ' @' || session_id || ') ' || content)
            FROM turns),
        cand AS MATERIALIZED (
            SELECT qid, key, chars, CASE WHEN leg = 0 THEN CAST(embedding AS DOUBLE[]) END AS vec,
                   row_number() OVER (PARTITION BY qid ORDER BY leg, rank) AS pos
            FROM ordered JOIN shown USING (key) LEFT JOIN fv ON key = 'L1:' || fv.id),
        fold AS (
            SELECT qid, 0::BIGINT AS pos, []::VARCHAR[] AS selected, []::DOUBLE[][] AS vecs, 0::BIGINT AS used,
                   0::BIGINT AS duplicates, 0::BIGINT AS overflow FROM (SELECT DISTINCT qid FROM cand)
            UNION ALL
            SELECT qid, pos, CASE WHEN take THEN list_append(selected, key) ELSE selected END,
                   CASE WHEN take AND vec IS NOT NULL THEN list_append(vecs, vec) ELSE vecs END,
                   used + CASE WHEN take THEN chars ELSE 0 END, duplicates + duplicate::INT,
                   overflow + (NOT take AND NOT duplicate)::INT
            FROM (SELECT *, NOT duplicate AND len(selected) < 8 AND (used + chars <= 6000 OR len(selected) = 0) AS take
                  FROM (SELECT f.qid, c.pos, c.key, c.chars, c.vec, f.selected, f.vecs, f.used, f.duplicates, f.overflow,
                               len(f.selected) < 8 AND c.vec IS NOT NULL AND len(list_filter(f.vecs,
                                   lambda s: list_dot_product(s, c.vec) >= 0.3)) > 0 AS duplicate
                        FROM fold f JOIN cand c ON c.qid = f.qid AND c.pos = f.pos + 1)))
        SELECT qid, array_to_string(arg_max(selected, pos), ' ') AS selected, arg_max(used, pos) AS used,
               arg_max(duplicates, pos) AS duplicates, arg_max(overflow, pos) AS overflow FROM fold GROUP BY qid""",
)
def recall_hybrid(spark, path):
    """The flagship: every question answered from facts, scenarios and raw turns within 6,000 characters."""
    out = recall.recall(
        _questions(spark, path), _facts(spark, path), _scenarios(spark, path), v.turns(spark, path), redundant=0.3
    )
    return out.withColumn("selected", F.array_join("selected", " "))
