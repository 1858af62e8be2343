"""Shared symbols and files of many streams that meet in one file, against brute force."""

import itertools
import random
import time

from mnemoloom.operators import collide


def test_a_file_of_many_sets(spark):
    rng = random.Random(5)
    touched = {n: rng.sample(range(100), 40) for n in range(400)} | {1000: list(range(100, 104)), 1001: [100, 101], 1002: [100]}
    file_of = {n: "busy.js" if n < 400 else "whole.js" for n in touched} | {1002: "alone.js"}
    changes = spark.createDataFrame([(f"s{s:03}", n, file_of[n]) for n, many in touched.items() for s in many], "stream string, node_id long, file string")
    files = changes.select("stream", "file").distinct()
    pairs = lambda many: set(itertools.combinations(sorted(f"s{s:03}" for s in many), 2))
    symbols, fought, together, of_file = {}, {}, {}, {}
    for n, many in touched.items():
        of_file.setdefault(file_of[n], set()).update(many)
        for p in pairs(many):
            symbols[p] = symbols.get(p, 0) + 1
            fought.setdefault(p, set()).add(file_of[n])
    for many in of_file.values():
        for p in pairs(many):
            together[p] = together.get(p, 0) + 1
    wanted = {p: (symbols.get(p, 0), together[p] - len(fought.get(p, ()))) for p in together}
    start = time.monotonic()
    got = {(r.a, r.b): (r.shared_symbols, r.shared_files) for r in collide.shared(files, changes).collect()}
    assert got == wanted
    # 312,000 pairs of one file: seconds told apart by hash, minutes when each is compared with all others.
    assert time.monotonic() - start < 25


def test_ranges_are_read_once_and_meet_as_lines(spark):
    rng = random.Random(7)
    place = lambda: rng.choice(["a.js", "b.js", None])
    at = {n: (rng.choice(["a.js", "b.js"]), rng.choice([1, 40, 63, 64, 65, 127, 128, 129, 300])) for n in range(14)}
    hunks = [(f"s{s:02}" if s else None, place(), lo, lo + rng.choice([-70, -2, -1, 0, 1, 64, 200])) for s in range(70) for lo in rng.choices([1, 62, 63, 64, 65, 128, 300], k=2)]
    hunks += [("s01", "a.js", None, 5), ("s02", "a.js", 5, None)]
    calls = [(rng.randrange(20), rng.randrange(20)) for _ in range(30)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            read.add(rows.num_rows)
            yield rows

    schema = "stream string, file string, lo int, hi int"
    ranges = spark.createDataFrame(hunks, schema).mapInArrow(counted, schema)
    syms = spark.createDataFrame([(n, f"n{n}", f, line) for n, (f, line) in at.items()], "node_id long, name string, file string, line int")
    owned = []
    for n, (f, line) in at.items():
        same = [m for m, o in at.items() if o == (f, line)]
        later = [o[1] for o in at.values() if o[0] == f and o[1] > line]
        owned.append((n, f, line, line - 1 if n != max(same) else min(later) - 1 if later else 2_147_483_647))
    met = {(s, n, f) for s, g, lo, hi in hunks if lo is not None and hi is not None for n, f, a, b in owned if f == g and hi >= a and lo <= b}
    files, changes = collide.stream_changes(ranges, syms)
    assert {tuple(r) for r in changes.select("stream", "node_id", "file").collect()} == met
    assert {tuple(r) for r in files.collect()} == {(s, f) for s, f, _, _ in hunks}
    wanted = {}
    touched, opened = {}, {}
    for s, n, _ in met:
        touched.setdefault(s, set()).add(n)
    for s, f, _, _ in hunks:
        opened.setdefault(s, set()).update({f} - {None})
    for a, b in itertools.combinations(sorted(s for s in opened if s), 2):
        both, x, y = touched.get(a, set()) & touched.get(b, set()), touched.get(a, set()), touched.get(b, set())
        row = (
            len(both), len(opened[a] & opened[b]) - len({at[n][0] for n in both}),
            len({d for s, d in calls if s in x and d in y}), len({d for s, d in calls if s in y and d in x}),
        )
        if any(row):
            wanted[a, b] = row
    edges = spark.createDataFrame(calls, "src long, dst long")
    got = {(r.a, r.b): tuple(r)[2:] for r in collide.compare(files, changes, edges).collect()}
    assert got == wanted
    # Not once for the files, once for how far files reach and once for the symbols.
    assert read.value == len(hunks)
    masks = collide.stream_masks(ranges)
    streams = collide.Streams.of_masks(masks, syms)
    assert {(r.a, r.b): tuple(r)[2:] for r in streams.compare(edges).collect()} == wanted
    # 70 streams are two words a symbol at most.
    assert streams.symbols.count() <= 2 * len(at)
