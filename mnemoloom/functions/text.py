"""Text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _drop_right(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.lit(n))


def stem(word: Column | str) -> Column:
    """Trim the endings that separate a question from an identifier."""
    w = _col(word)
    n = F.length(w)
    plain = (
        F.when((n >= 6) & w.endswith("ing"), _drop_right(w, 3))
        .when((n >= 5) & w.endswith("ed"), _drop_right(w, 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), _drop_right(w, 1))
        .otherwise(w)
    )
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(_drop_right(w, 3), F.lit("y")))
        .when((n > 4) & w.rlike("(ss|sh|ch|x|z)es$"), _drop_right(w, 2))
        # "-ing" drops the "e" of its word, so both spellings lose it.
        .otherwise(F.when((F.length(plain) > 4) & plain.endswith("e"), _drop_right(plain, 1)).otherwise(plain))
    )


def words(text: Column | str, keep_stop: bool = False) -> Column:
    """Lower-case words of three letters or more, split at case boundaries too."""
    spaced = F.regexp_replace(_col(text), "[^A-Za-z0-9]+", " ")
    spaced = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    split = F.split(F.lower(F.coalesce(spaced, F.lit(""))), " ")
    if keep_stop:
        return F.filter(split, lambda w: F.length(w) >= 3)
    return F.filter(split, lambda w: (F.length(w) >= 3) & ~w.isin(fixed.SYMBOL_STOPWORDS))


def tokens(text: Column | str, keep_stop: bool = False) -> Column:
    """Stemmed words of a sentence, an identifier or a path."""
    return F.transform(words(text, keep_stop), stem)


def query_terms(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def fold_accents(text: Column | str) -> Column:
    return F.translate(_col(text), fixed.ACCENTED, fixed.UNACCENTED)


def index_tokens(text: Column | str) -> Column:
    """The tokens a keyword index files a text under."""
    folded = fold_accents(F.lower(F.coalesce(_col(text), F.lit(""))))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def keyword_terms(text: Column | str) -> Column:
    """Informative words of a memory query, repeats kept, as index tokens.

    A word holding an underscore stands for its parts.
    """
    raw = F.transform(F.regexp_extract_all(_col(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower)
    kept = F.filter(raw, lambda w: (F.length(w) > 2) & ~w.isin(fixed.MEMORY_STOPWORDS))
    return F.filter(F.flatten(F.transform(kept, lambda w: F.split(fold_accents(w), "_"))), lambda w: w != "")


def flatten(text: Column | str) -> Column:
    """Same words, ignoring the things that are not words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", " "))


def flat_key(text: Column | str) -> Column:
    """A fixed-width stand-in for `flatten`, so shuffles move 64 bytes and not whole texts."""
    return F.sha2(flatten(text), 256)


def redact(text: Column | str) -> Column:
    """Replace well-known secret shapes."""
    out = F.coalesce(_col(text), F.lit(""))
    for pattern, replacement in fixed.SECRET_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def normalise_path(raw: Column | str) -> Column:
    """Reduce a URL or a route to what both of its ends agree on."""
    p = F.trim(_col(raw))
    p = F.regexp_replace(p, r"(?i)^[a-z]+://[^/]+", "")
    p = F.regexp_replace(p, r"\?.*$", "")
    p = F.regexp_replace(p, r"\$\{[^}]*\}", ":_")
    p = F.regexp_replace(p, r":[A-Za-z_]\w*", ":_")
    p = F.regexp_replace(p, r"\{[^}]*\}", ":_")
    p = F.regexp_replace(p, r"<[^>]*>", ":_")
    p = F.regexp_replace(p, r"/+$", "")
    return F.lower(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def base_expression(raw: Column | str) -> Column:
    """The leading base-URL expression of a call site's literal, or null."""
    found = F.regexp_extract(F.trim(_col(raw)), fixed.BASE_EXPRESSION, 1)
    return F.nullif(found, F.lit(""))


def without_base(raw: Column | str) -> Column:
    trimmed = F.trim(_col(raw))
    rest = F.regexp_extract(trimmed, fixed.BASE_EXPRESSION, 2)
    return F.when(rest != "", rest).otherwise(trimmed)


def base_name(base: Column | str) -> Column:
    """What a base expression calls the thing it points at."""
    inner = F.regexp_replace(_col(base), r"^[${%]+|[}%]+$", "")
    parts = F.filter(F.split(inner, r"[.\[\]]"), lambda p: p != "")
    word = F.coalesce(F.try_element_at(parts, F.lit(-1)), inner)
    word = F.regexp_replace(word, fixed.BASE_SUFFIX, "")
    word = F.lower(F.trim(F.regexp_replace(word, "[_-]+", " ")))
    return F.nullif(word, F.lit(""))


def bare_name(label: Column | str) -> Column:
    """A label up to its first parenthesis."""
    return F.trim(F.regexp_replace(_col(label), r"(?s)\(.*$", ""))


def line_of(location: Column | str) -> Column:
    """The digits after L, or null."""
    digits = F.regexp_extract(F.coalesce(_col(location), F.lit("")), r"L(\d+)", 1)
    return F.when(digits != "", digits.cast("int"))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^\\/]*)$", 1)


def dirname(path: Column | str) -> Column:
    p = _col(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def estimated_tokens(chars: Column | str) -> Column:
    return round_half_up(_col(chars) / F.lit(4))


def percent_smaller(out: Column, base: Column) -> Column:
    return F.when(base > 0, round_half_up((F.lit(1) - out / base) * 100))


def human_bytes(b: Column | str) -> Column:
    n = _col(b)
    return (
        F.when(n > 1e9, F.format_string("%.1f GB", n / F.lit(1e9)))
        .when(n > 1e6, F.format_string("%.0f MB", n / F.lit(1e6)))
        .otherwise(F.format_string("%.0f KB", n / F.lit(1e3)))
    )


def age_days(epoch_seconds: Column | str, now: Column) -> Column:
    return F.floor((now - _col(epoch_seconds)) / F.lit(86400))


def ellipsis(text: Column | str, n: int) -> Column:
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def clip_with_remainder(text: Column | str, n: int = 1200) -> Column:
    """A long result, cut, saying how much was left out."""
    t = _col(text)
    more = F.concat(
        F.substring(t, 1, n), F.lit("\n… "), (F.length(t) - F.lit(n)).cast("string"), F.lit(" more characters")
    )
    return F.when(F.length(t) > n, more).otherwise(t)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


# Predicates ----------------------------------------------------------------
def is_test_file(path: Column | str) -> Column:
    return _col(path).rlike(fixed.TEST_PATH)


def is_survey_code(path: Column | str) -> Column:
    return _col(path).rlike(fixed.SURVEY_CODE_EXT)


def is_fresh_code(path: Column | str) -> Column:
    return _col(path).rlike(fixed.FRESHNESS_CODE_EXT) & ~_col(path).rlike(fixed.FRESHNESS_GENERATED)


def is_file_node(name: Column | str, file: Column | str) -> Column:
    return F.coalesce(_col(name) == basename(file), F.lit(False))


def is_route(path: Column | str) -> Column:
    return _col(path).rlike(fixed.ROUTE_SHAPE) & ~_col(path).rlike(fixed.ROUTE_ASSET)


def is_comment(line: Column | str) -> Column:
    return _col(line).rlike(fixed.COMMENT_LINE)


def is_failure(line: Column | str) -> Column:
    return _col(line).rlike("|".join(fixed.FAILURE_PATTERNS))


def is_summary(line: Column | str) -> Column:
    return _col(line).rlike("|".join(fixed.SUMMARY_PATTERNS))


def clamp(value, low, high):
    """Parameter clamping, driver side."""
    return min(max(value, low), high)
