"""Conversation repair against a plain walk over states that keeps the cheapest, least audit of each."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from mnemoloom.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def least(rows):
    """Cheapest (cost, audit, lines) over rows of (role, text, fault): a walk with one best way per state."""
    states = {0: (0, "", ())}

    def insert(states):
        for _ in range(4):
            for q in range(4):
                if q in states:
                    c, a, lines = states[q]
                    t = repair.NEEDED[q]
                    new = (c + 5, a + "I", lines + (("user:", "assistant:")[t - 2],))
                    if t not in states or new < states[t]:
                        states[t] = new
        return states

    for role, text, fault in rows:
        new = {}
        for q, (c, a, lines) in insert(dict(states)).items():
            ways = [(q, (c + 2, a + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                initial = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
                if initial in repair.NEXT[q]:
                    ways.append((repair.NEXT[q][initial], (c + extra, a + "K", lines + (f"{role}:{text}",))))
                t = repair.NEEDED[q]
                ways.append((t, (c + 1 + extra, a + "R", lines + (f"{('user', 'assistant')[t - 2]}:{text}",))))
            for t, way in ways:
                if t not in new or way < new[t]:
                    new[t] = way
        states = new
    return min(v for q, v in insert(states).items() if q in (0, 3))


def brute(rows):
    out = []
    kept = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = [r for r in kept if r[0] == conv]
        order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()[:16])
        mine.sort(key=order)
        seen, told, count = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in mine:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
            if fault:
                count[fault] += 1
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        cost, audit, lines = least(told)
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_least_audits_in_blocks():
    """Conversations of symbols, cut anywhere, against the plain walk."""
    for seed in range(300):
        r = random.Random(seed)
        talks = [[r.choice([r.randrange(16), 4, 8]) for _ in range(r.randint(1, 25))] for _ in range(4)]
        for talk in talks:
            cuts = sorted({0, len(talk), *(r.randint(1, len(talk)) for _ in range(3))})
            blocks = [np.array(talk[a:b]) for a, b in itertools.pairwise(cuts)]
            pay = [repair.END]
            for m in repair.matrices(blocks)[::-1]:
                pay.insert(0, (m + pay[0]).min(axis=1))
            final = np.arange(len(blocks)) == len(blocks) - 1
            audits, exits, begin = repair.least_audits(blocks, np.array(pay[1:]), final)
            state, audit = 0, b""
            for four, leave in zip(audits, exits):
                audit += four[state]
                state = leave[state]
            role = {0: "s", 1: "u", 2: "a", 3: "x"}
            rows = [(role[s // 4], "", (None, "blank", "duplicate", "truncated")[s % 4]) for s in talk]
            assert (int(begin[0][0]), audit.decode()) == least(rows)[:2] and pay[0][0] == begin[0][0]


def talks(seed):
    r = random.Random(seed)
    texts = ["Hello.", "Well?", "no end", "No end ", "Yes!\n", "", " \t", "é…", "a.b", "Long. " * 50]
    rows = []
    for conv in range(40):
        role = ["system"] * (r.random() < 0.4) + ["user", "assistant"] * r.randint(0, 6)
        for turn, x in enumerate(role):
            if r.random() < 0.9:
                rows.append((conv, turn + (r.random() < 0.1), r.choice([x] * 5 + ["tool", "", None, "user", "assistant", "unit", "system"]), r.choice([*texts, f"Own {turn}.", f"Own {turn}!", None])))
    rows += [(None, None, "user", f"t{k}.") for k in range(5)] + [(None, 3, None, None), (99, None, "user", "Only.")]
    rows += [(500, k, ("user", "assistant")[k % 2], f"Turn {k // 2 if k % 5 else 0}.") for k in range(300)] + [(501, 1, "user", "Same.")] * 60 + [(-7, k - 40, "user", "Again.") for k in range(60)]
    dropped = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block, chunk", [(1, 1024, 1 << 20), (2, 3, 60), (3, 50, 400)])
def test_against_a_plain_walk(spark, monkeypatch, seed, block, chunk):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "CHUNK_BYTES", chunk)
    rows = talks(seed)
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, copies int")
    got = [tuple(x) for x in repair.report(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert repair.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
