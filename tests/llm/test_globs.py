"""The automaton against globs turned into regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa

from mnemoloom.llm import globs
from mnemoloom.llm.common import utf8


def pattern(glob):
    out = ""
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out += {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return re.compile(out)


def test_random_globs():
    r = random.Random(1)
    for _ in range(60):
        rules = ["".join(r.choice(["a", "b", "ab", "/", "*", "**", "?", ".", "é", "c" * 70]) for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 12))]
        texts = ["".join(r.choice("aab/.cé語") for _ in range(r.randint(0, 12))) for _ in range(40)] + ["c" * 70 + "a", "", None]
        got = globs.Automaton(rules).matches(*utf8(pa.array(texts, pa.string())))
        want = np.array([[bool(pattern(g).fullmatch(t or "")) for g in rules] for t in texts])
        assert (got == want).all()


RULES = [globs.host_rule("block", "net", "/"), globs.host_rule("allow", "example.net", "/en/"), globs.Rule("*casino*/**", "block")]


def test_verdicts(spark):
    rows = [
        (1, "http://a.example.NET/en/x?q"), (2, "http://example.net/de"), (3, "http://net"), (4, "http://net/"), (5, "http://xnet/"), (6, None), (7, "no scheme"),
        (8, "s://my-casino.com/"), (9, "s://my-casino.com"), (10, "a://b://c/d"), (11, "http://a.com/x.net/y"), (12, "http://h.net/" + "é" * 5000), (1, "http://a.example.NET/en/x?q"),
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u in rows], "page_id long, url string, verdict string")
    got = sorted(((x.page_id, x.host, x.path[:20], x.rule, x.verdict) for x in globs.judge(df, RULES, keep=["page_id"]).collect()), key=str)
    assert got == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de", "net/", "block"),
        (3, "net", "", None, "allow"), (4, "net", "/", "net/", "block"), (5, "xnet", "/", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "my-casino.com", "/", None, "block"), (9, "my-casino.com", "", None, "allow"), (10, "b:", "//c/d", None, "allow"), (11, "a.com", "/x.net/y", None, "allow"),
        (12, "h.net", "/" + "é" * 19, "net/", "block"),
    ], key=str)
    assert globs.judge(df.limit(0), RULES).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert globs.judge(df.limit(0), RULES).count() == 0
