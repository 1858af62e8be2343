"""The registered queries: each operator over its whole table, reduced to the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import prepare


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{path}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    from . import rotations

    return rotations.near_duplicates(_table(spark, path, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_ngram_jaccard(spark: SparkSession, path: str) -> DataFrame:
    from . import partenum

    out = partenum.similar_components(_table(spark, path, "documents"), n_words=4, num=85, den=100, links=True)
    return out.drop("mark").withColumnRenamed("id", "doc_id")


def op3_warc_zip(spark: SparkSession, path: str) -> DataFrame:
    from . import wacz

    return wacz.round_trip(_table(spark, path, "pages"))


def op4_byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    from . import bpe

    name = "byte_bpe_multi_50k.tiktoken"
    ranks = bpe.load_ranks(public_tokenizers.path(name))
    return bpe.digests(_table(spark, path, "documents"), ranks, public_tokenizers.PATTERN, name)


def op5_toxicity_chain(spark: SparkSession, path: str) -> DataFrame:
    from . import toxicity

    return toxicity.report(_table(spark, path, "documents"), _table(spark, path, "labels"))


def op6_suffix_decontamination(spark: SparkSession, path: str) -> DataFrame:
    from . import suffix

    return suffix.report(_table(spark, path, "documents"), _table(spark, path, "benchmark"))


def op7_secret_scan(spark: SparkSession, path: str) -> DataFrame:
    from . import secretscan

    return secretscan.report(_table(spark, path, "documents"))


def op8_language_id(spark: SparkSession, path: str) -> DataFrame:
    from . import langid

    return langid.report(_table(spark, path, "documents"))


# The rules of the contract, and globs for what they leave open.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
GLOBS = ("*casino*/**", "*free-bets*/**", "*.xxx/**", "**/login?", "**/*.exe", "**/*.zip")


def op9_url_globs(spark: SparkSession, path: str) -> DataFrame:
    from . import globs

    rules = [*(globs.host_rule(*r) for r in HOST_RULES), *(globs.Rule(g, "block") for g in GLOBS)]
    return globs.judge(_table(spark, path, "pages"), rules, keep=["page_id"])


def op10_token_counts(spark: SparkSession, path: str) -> DataFrame:
    from . import tokens

    name = "byte_bpe_50k.json"
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return tokens.report(_table(spark, path, "documents"), f.read(), name)


def op11_conversation_repair(spark: SparkSession, path: str) -> DataFrame:
    from . import repair

    return repair.report(_table(spark, path, "conversations"))


def op12_merkle_manifest(spark: SparkSession, path: str) -> DataFrame:
    from . import merkle

    return merkle.report(_table(spark, path, "documents"))


def op13_suffix_array_dedup(spark: SparkSession, path: str) -> DataFrame:
    from . import lyndon

    return lyndon.report(_table(spark, path, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_ngram_jaccard, op3_warc_zip, op4_byte_bpe, op5_toxicity_chain, op6_suffix_decontamination, op7_secret_scan,
        op8_language_id, op9_url_globs, op10_token_counts, op11_conversation_repair, op12_merkle_manifest, op13_suffix_array_dedup,
    )
}
SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
            WHERE label IS NOT NULL AND list_bool_and(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x)))
                AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        ), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counted USING (vec_id)
    """,
    "op6_suffix_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), i AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL
        ), starts AS (
            SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0
        ), windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM starts),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        ahead AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM words),
        runs AS (SELECT doc_id, p, n, array_to_string(list_slice(l, 1, n), ' ') AS g FROM ahead, (SELECT DISTINCT n FROM windows) WHERE len(l) >= n),
        hits AS (SELECT doc_id, p, runs.n, item_id FROM runs JOIN windows ON runs.n = windows.n AND runs.g = windows.g),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op3_warc_zip": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op9_url_globs": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), judged AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM split
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN path LIKE '/%' AND (host LIKE '%casino%' OR host LIKE '%free-bets%' OR ('.' || host) LIKE '%.xxx') THEN 'block'
            WHEN path LIKE '%/login_' AND path NOT LIKE '%/login/' THEN 'block'
            WHEN path LIKE '%.exe' OR path LIKE '%.zip' THEN 'block' ELSE 'allow' END AS verdict
        FROM judged
    """,
    "op11_conversation_repair": oracles.repair(),
    "op12_merkle_manifest": oracles.merkle(),
    "op13_suffix_array_dedup": oracles.REPEATS,
}
