"""Secret scans in SQL expressions: patterns, and sliding-window entropy over candidate strings.

Where a pattern matches follows from the pieces between its matches; lengths are summed in blocks,
so a text with very many matches costs no more than their number times a block. Entropy is that of a
window that moves over a candidate one character at a time; a table of counts and the sum of
c * log2(c) are carried along, and each step changes two entries of one and two terms of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of secrets with a shape of their own; fixed values. The second group of `assign` must have 12 characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
# A candidate is of the first class that holds all of its characters, and a secret if a window of it has that many bits.
CLASSES = (("hexadecimal", r"\A[0-9A-Fa-f]+\z", 3.0), ("alphanumeric", r"\A[0-9A-Za-z]+\z", 3.7), ("base64", r"\A.*\z", 3.8))
# Candidates that are never secrets: numbers, identifiers, digests of packages.
ALLOWED = (r"\A[0-9_/=+-]+\z", r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z", r"\Asha(?:256|384|512)-")
# Words and paths of words: no digit, and a capital after a small letter at most once in so many characters.
WORDS, HUMP = r"\A[A-Za-z_/=+-]+\z", r"[a-z][A-Z]"
WORD_LENGTH = 6
# Placeholders: what is left of a candidate without them is judged, if it still fills a window.
PLACEHOLDER = r"(?i)example|placeholder|changeme|x{6,}|0{6,}|123456"

BLOCK = 64


def _places(gaps: str, found: str) -> str:
    """First position of each match: `gaps` are the texts before each match (and the last), `found` the matches."""
    lengths = f"transform({found}, (m, i) -> length({gaps}[i]) + length(m))"
    return f"""transform(array({lengths}), w -> transform(
        array(transform(sequence(0, (size(w) - 1) div {BLOCK}), b -> aggregate(slice(w, b * {BLOCK} + 1, {BLOCK}), 0L, (s, x) -> s + x))), sums -> transform(
            array(aggregate(sums, named_struct('at', 0L, 'all', cast(array() as array<bigint>)),
                (s, x) -> named_struct('at', s.at + x, 'all', concat(s.all, array(s.at))), s -> s.all)), heads -> transform({found}, (m, i) ->
                    heads[i div {BLOCK}] + aggregate(slice(w, i div {BLOCK} * {BLOCK} + 1, i % {BLOCK}), 0L, (s, x) -> s + x) + length({gaps}[i])
        ))[0])[0])[0]"""


def _window_entropy() -> str:
    """Largest entropy in bits of a window of the candidate `c` (an expression named c in a lambda)."""
    f = lambda n: f"(case when {n} > 1 then {n} * log2({n}) else 0D end)"
    come, gone = "ascii(chars[i - 1])", f"(case when i > {WINDOW} then ascii(chars[i - 1 - {WINDOW}]) else -1 end)"
    n_in = "s.counts[x]"
    n_out = "(s.counts[y] + case when x = y then 1 else 0 end)"
    total = f"s.total + {f(f'({n_in} + 1)')} - {f(n_in)} - case when y < 0 then 0D else {f(n_out)} - {f(f'({n_out} - 1)')} end"
    step = f"""(s, i) -> transform(array(named_struct('x', {come}, 'y', {gone})), p -> transform(array({total.replace('x]', 'p.x]').replace('y]', 'p.y]').replace('x = y', 'p.x = p.y').replace('y < 0', 'p.y < 0')}), t -> named_struct(
        'counts', transform(s.counts, (v, k) -> v + case when k = p.x then 1 else 0 end - case when k = p.y then 1 else 0 end),
        'total', t, 'least', case when i >= {WINDOW} then least(s.least, t) else s.least end))[0])[0]"""
    return f"""transform(array(split(c, '')), chars -> aggregate(sequence(1, size(chars)), named_struct('counts', array_repeat(0, 128), 'total', 0D, 'least', double('Infinity')),
        {step}, s -> log2({WINDOW}D) - s.least / {WINDOW}D))[0]"""


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern + '"'


def scan(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """All columns, and `spans`: kind, start and end (code points, end exclusive) of every secret, by start and kind.

    Null and empty texts have none. Rows are independent, so repeated ones repeat. An input column of
    the same name is replaced. Matches of one kind do not overlap; those of different kinds may.
    """
    source = docs.drop(spans) if spans != text else docs
    names = source.columns
    t = F.coalesce(F.col(text), F.lit(""))
    work = source.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), t.alias("t"))
    patterns = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE))
    work = work.select("*", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"{k}_found") for k, p in patterns])
    some = lambda k, value: F.when(F.size(f"{k}_found") > 0, value)
    work = work.select(
        "*", some("assign", F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).alias("assign_values"),
        *[some(k, F.split("t", p, -1)).alias(f"{k}_gaps") for k, p in patterns],
    )
    listed = []
    for order, (k, _) in enumerate(patterns):
        made = f"transform({k}_found, (m, i) -> named_struct('start', places[i], 'kind', {order}, 'end', places[i] + length(m), 'text', m))"
        made = f"transform(array({_places(f'{k}_gaps', f'{k}_found')}), places -> {made})[0]"
        if k == "assign":
            made = f"filter({made}, (m, i) -> length(assign_values[i]) >= {ASSIGN_LEAST})"
        if k == "entropy":
            allowed = " or ".join(f"c rlike {_sql(p)}" for p in ALLOWED)
            allowed += f" or (c rlike {_sql(WORDS)} and regexp_count(c, {_sql(HUMP)}) * {WORD_LENGTH} <= length(c))"
            least = "case " + " ".join(f"when c rlike {_sql(p)} then {bits}D" for _, p, bits in CLASSES) + " end"
            judged = f"transform(array(regexp_replace(c, {_sql(PLACEHOLDER)}, '')), c -> length(c) >= {WINDOW} and {_window_entropy()} >= {least})[0]"
            secret = f"transform(array(m.text), c -> not ({allowed}) and {judged})[0]"
            made = f"filter({made}, m -> {secret})"
        bare = f"transform({made}, m -> named_struct('start', m.start, 'kind', m.kind, 'end', m.end))"
        listed.append(F.when(F.size(f"{k}_found") > 0, F.expr(bare)).otherwise(F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")))
    work = work.select("row", F.array_sort(F.concat(*listed)).alias("s"))
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return work.select(*[F.col("row").getField(c).alias(c) for c in names], F.expr(f"transform(s, m -> named_struct('kind', {kinds}[m.kind], 'start', m.start, 'end', m.end))").alias(spans))


def listing(spans: Column) -> Column:
    """`kind:start:end` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m.kind, m.start, m.end)), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same columns, with every secret of the text replaced by a mark. Null stays null."""
    found = scan(docs, text, "_spans")
    body = f"""aggregate(_spans, named_struct('at', 0L, 'out', ''), (s, m) -> named_struct(
        'at', greatest(s.at, m.end),
        'out', case when m.start >= s.at then concat(s.out, substring({text}, int(s.at + 1), int(m.start - s.at)), '{mark}') else s.out end),
        s -> concat(s.out, substring({text}, int(s.at + 1), length({text}))))"""
    return found.withColumn(text, F.when(F.size("_spans") > 0, F.expr(body)).otherwise(F.col(text))).drop("_spans")


def report(docs: DataFrame) -> DataFrame:
    """Per document: base spans by kind, their digest, and all spans."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda m: m.kind == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter(spans, lambda m: m.kind != "entropy")
    found = scan(docs.select("doc_id", "text"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listing(base), 256).alias("base_sha256"), listing(spans).alias("spans"))
