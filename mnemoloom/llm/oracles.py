"""SQL of the queries whose statement is built from parts."""

from __future__ import annotations

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string: eight shifts per byte, which enters before the first of them."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda a, x: {step}), CAST(4294967295 AS BIGINT))"


def _edit(state: str, cost: str, letter: str, line: str = "''") -> str:
    """A state is its cost in nine digits, its audit, a separator, and what is written; so the least string is the least of the cheapest."""
    paid = f"lpad(CAST(CAST(left({state}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0')"
    return f"CASE WHEN {state} IS NOT NULL THEN {paid} || substr(split_part({state}, chr(1), 1), 10) || '{letter}' || chr(1) || substr({state}, strpos({state}, chr(1)) + 1) || {line} END"


def _inserted(source: str, columns: str) -> str:
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    once = f"SELECT {columns}, s0, s1, s3, least(s2, {_edit('s0', '5', 'I', user)}, {_edit('s1', '5', 'I', user)}, {_edit('s3', '5', 'I', user)}) AS s2 FROM {source}"
    twice = f"SELECT {columns}, s0, s1, s2, least(s3, {_edit('s2', '5', 'I', assistant)}) AS s3 FROM ({once})"
    return f"SELECT {columns}, s0, s1, s3, least(s2, {_edit('s3', '5', 'I', user)}) AS s2 FROM ({twice})"


def repair() -> str:
    """A walk over the rows that keeps one best way to each state."""
    stays = "fault IN ('none', 'truncated')"
    extra = "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
    keep = lambda s, i: f"CASE WHEN {stays} AND initial = '{i}' THEN {_edit(s, extra, 'K', 'role || chr(58) || text || chr(10)')} END"
    role = lambda s, r: f"CASE WHEN {stays} THEN {_edit(s, '1 + ' + extra, 'R', chr(39) + r + ':' + chr(39) + ' || text || chr(10)')} END"
    gone = lambda s: _edit(s, "2", "D")
    to_user = ", ".join(f(s, x) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (role, "user")))
    columns = "conv_id, n, role, text, initial, fault"
    return f"""
        WITH RECURSIVE drawn AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d
            FROM conversations
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM drawn, range(2) t(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(sha256(length(role) || ':' || role || text), 32)) AS n,
                rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
            FROM damaged
        ), told AS (
            SELECT *, left(role, 1) AS initial, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
            FROM numbered
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
            FROM told GROUP BY conv_id
        ), walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS n, '000000000' || chr(1) AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM counted
            UNION ALL
            SELECT conv_id, n, {gone("s0")} AS s0, least({gone("s1")}, {keep("s0", "s")}) AS s1, least({gone("s2")}, {to_user}) AS s2, least({gone("s3")}, {keep("s2", "a")}, {role("s2", "assistant")}) AS s3
            FROM ({_inserted("(SELECT t.conv_id, t.n, role, text, initial, fault, s0, s1, s2, s3 FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1)", columns)})
        ), ended AS (
            SELECT conv_id, least(s0, s3) AS best FROM ({_inserted("(SELECT w.* FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n)", "conv_id")})
        ), answers AS (
            SELECT c.*, CAST(left(best, 9) AS BIGINT) AS cost, substr(split_part(best, chr(1), 1), 10) AS audit, substr(best, strpos(best, chr(1)) + 1) AS written
            FROM counted c JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(written, length(written) - 1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN answers a ON o.conv_id IS NOT DISTINCT FROM a.conv_id
    """


def _leaf(text: str) -> str:
    parts = [*(f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")), text]
    return "sha256(" + " || ".join(f"CASE WHEN {p} IS NULL THEN '-' ELSE strlen({p}) || ':' || {p} END" for p in parts) + ")"


def _levels(name: str, depth: int) -> str:
    """Levels above `name`0 (g, pos, h, n), a node with its neighbours on both sides."""
    out = []
    for k in range(depth):
        frame = "OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(
            f"{name}{k}s AS (SELECT *, coalesce(string_agg(h, '') {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
        )
        out.append(
            f"{name}{k + 1} AS (SELECT g, pos // 16 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h, (n + 15) // 16 AS n FROM {name}{k} GROUP BY g, pos // 16, n)"
        )
    return ", ".join(out)


def merkle(depth: int = 6, over: int = 3) -> str:
    """Levels written out: 16^6 documents of a source, 16^3 sources."""
    ways, at = [], "placed"
    for name, depths, group, place in (("a", depth, "g", "pos"), ("b", over, "0", "spos")):
        for k in range(depths):
            new = f"way{len(ways)}"
            ways.append(
                f"{new} AS (SELECT p.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || p.fold || s.r) ELSE p.fold END AS fold, p.beside || s.l || s.r AS beside) "
                f"FROM {at} p JOIN {name}{k}s s ON s.g = {'p.' + group if group == 'g' else group} AND s.pos = p.{place} // {16**k})"
            )
            at = new
    return f"""
        WITH named AS (
            SELECT *, coalesce('g' || source, '') AS g, {_leaf("text")} AS leaf,
                CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(f"translate(text, {UPPER}, {LOWER})")} END AS claim
            FROM documents
        ), leaves AS (
            SELECT doc_id, g, leaf, claim, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM named
        ), a0 AS (SELECT g, pos, leaf AS h, n FROM leaves), {_levels("a", depth)},
        sources AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a{depth}),
        b0 AS (SELECT 0 AS g, pos, h, n FROM sources), {_levels("b", over)},
        placed AS (
            SELECT l.doc_id, l.g, l.leaf, s.h AS subroot, b.h AS root, l.pos, s.pos AS spos, coalesce(l.claim, l.leaf) AS fold, '' AS beside
            FROM leaves l JOIN sources s USING (g), b{over} b
        ), {", ".join(ways)}
        SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {at}
    """


# Two characters per byte; removed runs are islands of covered windows, and what is kept stands between them.
REPEATS = """
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT k, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800),
    named AS (SELECT w.k, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM w JOIN d USING (k)),
    again AS (SELECT k, i FROM named WHERE m IN (SELECT m FROM named GROUP BY m HAVING count(*) > 1)),
    fresh AS (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 400 THEN 0 ELSE 1 END AS f FROM again),
    runs AS (SELECT k, min(i) AS a, max(i) + 400 AS b FROM (SELECT k, i, sum(f) OVER (PARTITION BY k ORDER BY i) AS r FROM fresh) GROUP BY k, r),
    parts AS (
        SELECT k, lag(b, 1, 0) OVER (PARTITION BY k ORDER BY a) AS a, a AS b FROM runs
        UNION ALL SELECT k, max(b), NULL FROM runs GROUP BY k
    ), kept AS (SELECT k, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, len(x) // 2) - a)), '' ORDER BY a) AS x FROM parts JOIN d USING (k) GROUP BY k),
    sums AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY k)
    SELECT doc_id, len(d.x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
    FROM d LEFT JOIN kept USING (k) LEFT JOIN sums USING (k)
"""
