"""The text functions of `functions.text` spelled in the oracle's SQL dialect."""

from __future__ import annotations

from ..functions import fixed


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def sql_stem(w: str) -> str:
    plain = (
        f"CASE WHEN length({w}) >= 6 AND {w} LIKE '%ing' THEN left({w}, -3) "
        f"WHEN length({w}) >= 5 AND {w} LIKE '%ed' THEN left({w}, -2) "
        f"WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, -1) ELSE {w} END"
    )
    return (
        f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, -3) || 'y' "
        f"WHEN length({w}) > 4 AND regexp_matches({w}, '(ss|sh|ch|x|z)es$') THEN left({w}, -2) "
        f"WHEN length({plain}) > 4 AND ({plain}) LIKE '%e' THEN left({plain}, -1) ELSE {plain} END"
    )


def sql_words(text: str) -> str:
    spaced = f"regexp_replace({text}, '[^A-Za-z0-9]+', ' ', 'g')"
    spaced = rf"regexp_replace({spaced}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    spaced = rf"regexp_replace({spaced}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return (
        f"list_filter(string_split(lower({spaced}), ' '), "
        f"lambda w: length(w) >= 3 AND w NOT IN {_in(fixed.SYMBOL_STOPWORDS)})"
    )


def sql_tokens(text: str) -> str:
    return f"list_transform({sql_words(text)}, lambda w: {sql_stem('w')})"


def sql_fold(text: str) -> str:
    return f"translate(lower({text}), '{fixed.ACCENTED}', '{fixed.UNACCENTED}')"


def sql_index_tokens(text: str) -> str:
    return rf"regexp_extract_all({sql_fold(text)}, '[\p{{L}}\p{{N}}]+')"


def sql_keyword_terms(text: str) -> str:
    raw = rf"list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w))"
    kept = f"list_filter({raw}, lambda w: length(w) > 2 AND w NOT IN {_in(fixed.MEMORY_STOPWORDS)})"
    split = f"flatten(list_transform({kept}, lambda w: string_split({sql_fold('w')}, '_')))"
    return f"list_filter({split}, lambda w: w <> '')"


def sql_bm25(docs: str, key: str, tokens: str, questions: str, name: str) -> str:
    """Common table expressions ending in `name` (qid, key, score)."""
    return f"""
        {name}_d AS (SELECT {key} AS k, {tokens} AS toks FROM {docs}),
        {name}_t AS (SELECT count(*) AS n, avg(len(toks)) AS mean_len FROM {name}_d),
        {name}_p AS (SELECT k, len, term, count(*) AS tf
                     FROM (SELECT k, len(toks) AS len, unnest(toks) AS term FROM {name}_d) GROUP BY ALL),
        {name}_q AS (SELECT qid, term, count(*) AS qtf
                     FROM (SELECT qid, unnest({sql_keyword_terms('text')}) AS term FROM {questions}) GROUP BY ALL),
        {name}_i AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf
                     FROM {name}_p, {name}_t GROUP BY term, n),
        {name} AS (SELECT qid, k, round(sum(qtf * idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len)))), 9) AS score
                   FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_i USING (term), {name}_t GROUP BY qid, k)"""
