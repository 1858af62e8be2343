"""Repair of damaged conversations at the least cost, with the least audit trail.

A repaired conversation is empty, or an optional system turn and then user and assistant in turn. Four states tell what
has been written (nothing, a system turn, a user turn, an assistant turn), and every edit (Keep, Rerole, Delete, Insert) is
an arc between states with a cost. Conversations are cut into blocks of rows, in order, wherever their rows lie:

* each block is a matrix of least costs between states, and folding the matrices from the end of a conversation gives
  what is still to pay behind every block, and so for every node (row and state) inside it;
* arcs that pay for what they cost are optimal. Their nodes are ranked by prefix doubling: by the first edit of
  the least audit that leads on from them, then by the first two, four, eight. An audit of 2^(k+1) edits is one of 2^k and
  another from where that ends, so the rank of the second half picks among the ends, and the pointers double. With the last
  ranks each node knows its next one, and pointers doubled once more lay out the paths;
* folding which state leaves a block for each that enters it gives the path of the whole conversation.

So no task holds a conversation. What is sequential by contract, the digest of a repaired conversation, reads its text in
order, as blocks that were joined before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Rows of a block, and bytes of repaired text that travel together.
BLOCK = 1024
CHUNK_BYTES = 1 << 20

SPACE = " \t\n\x0b\x0c\r"
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
LETTERS = b"DIKR"  # in ASCII order, so that their numbers compare as they do
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # by a role's initial
NONE, BLANK, DUPLICATE, CUT = range(4)  # faults
LEGAL = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
# States: nothing yet, after system, after user, after assistant. What a state takes next, by initial, and what is written for it.
NEXT = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
NEEDED = (2, 2, 3, 2)
FINAL = (0, 3)
INF = 1 << 40


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Cost and target state of Delete, Insert, Keep and Rerole for every symbol (initial * 4 + fault) and state; INF where there is none."""
    cost, target = np.full((16, 4, 4), INF), np.zeros((16, 4, 4), np.int64)
    for symbol in range(16):
        initial, fault = divmod(symbol, 4)
        extra = TRUNCATED if fault == CUT else 0
        for q in range(4):
            cost[symbol, q, 0], target[symbol, q, 0] = DELETE, q
            cost[symbol, q, 1], target[symbol, q, 1] = INSERT, NEEDED[q]
            if fault in (NONE, CUT):
                if initial in NEXT[q]:
                    cost[symbol, q, 2], target[symbol, q, 2] = extra, NEXT[q][initial]
                cost[symbol, q, 3], target[symbol, q, 3] = REROLE + extra, NEEDED[q]
    return cost, target


COST, TARGET = _symbols()


def _closure() -> np.ndarray:
    """Least costs of inserts alone between states."""
    out = np.full((4, 4), INF)
    for q in range(4):
        out[q, q] = 0
    for _ in range(4):
        for q in range(4):
            out[q] = np.minimum(out[q], INSERT + out[NEEDED[q]])
    return np.minimum(out, INF)


CLOSURE = _closure()
END = np.min([CLOSURE[:, q] for q in FINAL], axis=0)  # what is left to pay behind the last row


def _steps() -> np.ndarray:
    """Least cost between states over one row of every symbol, inserts before it included."""
    row = np.full((16, 4, 4), INF)
    for symbol in range(16):
        for q in range(4):
            for letter in (0, 2, 3):
                t = TARGET[symbol, q, letter]
                row[symbol, q, t] = min(row[symbol, q, t], COST[symbol, q, letter])
    return np.minimum((CLOSURE[None, :, :, None] + row[:, None, :, :]).min(axis=2), INF)


STEP = _steps()


def _backwards(symbols: list[np.ndarray], ends: np.ndarray) -> list[np.ndarray]:
    """For every block what is to pay before each of its rows, from what is to pay behind it (blocks x states, or x states x columns)."""
    order = np.argsort([-len(s) for s in symbols], kind="stable")
    lengths = np.array([len(symbols[k]) for k in order])
    out = [np.empty((len(s) + 1, *ends.shape[1:]), np.int64) for s in symbols]
    now = ends[order].astype(np.int64)
    for k, b in enumerate(order):
        out[b][-1] = now[k]
    for t in range(1, int(lengths.max(initial=0)) + 1):
        live = int(np.searchsorted(-lengths, -t, side="right"))
        at = np.array([symbols[b][len(symbols[b]) - t] for b in order[:live]])
        step = STEP[at]
        now = np.minimum((step[..., None] + now[:live, None]).min(axis=2) if now.ndim == 3 else (step + now[:live, None, :]).min(axis=2), INF)
        for k, b in enumerate(order[:live]):
            out[b][len(symbols[b]) - t] = now[k]
    return out


def matrices(symbols: list[np.ndarray]) -> np.ndarray:
    """Least cost between the states before and behind every block; inserts behind its last row are left to what follows."""
    ends = np.where(np.eye(4, dtype=bool), 0, INF)
    return np.stack([d[0] for d in _backwards(symbols, np.repeat(ends[None], len(symbols), axis=0))]) if symbols else np.zeros((0, 4, 4), np.int64)


def least_audits(symbols: list[np.ndarray], ends: np.ndarray, last: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The least of the cheapest audits through every block from each state, the state it leaves in, and what is to pay there in all.

    `ends` is what is left to pay behind each block; edits behind the rows are made in the `last` block of a conversation.
    """
    pay = _backwards(symbols, ends)
    sizes = np.array([len(s) + 1 for s in symbols], np.int64)
    begin = np.cumsum(sizes) - sizes  # first layer of each block
    layers = int(sizes.sum())
    d = np.concatenate(pay)
    block_end = np.zeros(layers, bool)
    block_end[begin + sizes - 1] = True
    closed = np.zeros(layers, bool)  # no edits from here
    closed[(begin + sizes - 1)[~last]] = True
    symbol = np.zeros(layers, np.int64)
    symbol[~block_end] = np.concatenate(symbols)
    # Optimal arcs: (layer, state, letter) -> (layer, state).
    cost, to = COST[symbol].copy(), TARGET[symbol]
    cost[block_end] = INF
    cost[block_end & ~closed, :, 1] = INSERT
    ahead = np.arange(layers)[:, None, None] + np.array([1, 0, 1, 1])[None, None, :] * np.ones((1, 4, 1), np.int64)
    ahead = np.minimum(ahead, layers - 1)
    optimal = (cost < INF) & (cost + d[ahead, to] == d[:, :, None])
    stop = ~optimal.any(axis=2)
    # First edits: rank 0 where the audit ends, else the least letter; their ends are a layer and a set of states.
    letter = np.where(stop, 0, optimal.argmax(axis=2) + 1)
    chosen = optimal & (np.arange(4)[None, None, :] + 1 == letter[:, :, None])
    rank = letter.reshape(-1)
    first = letter.reshape(-1) - 1
    layer = np.arange(layers)[:, None] + np.where(stop | (letter == 2), 0, 1)
    reach = np.zeros((layers, 4, 4), bool)
    at, q, k = np.nonzero(chosen)
    reach[at, q, to[at, q, k]] = True
    at, q = np.nonzero(stop)
    reach[at, q, q] = True
    layer, reach = np.minimum(layer, layers - 1).reshape(-1), reach.reshape(-1, 4)
    ends_at, ends_in = layer.copy(), reach.copy()
    big = np.iinfo(np.int64).max
    while True:
        onward = np.where(ends_in, rank.reshape(layers, 4)[ends_at], big)  # ranks of the second half, by end
        best = onward.min(axis=1)
        finer = np.unique(rank * (int(rank.max()) + 1) + best, return_inverse=True)[1]
        picked = onward == best[:, None]
        after = np.zeros_like(ends_in)
        lay = np.zeros_like(ends_at)
        for s in range(4):
            node = ends_at * 4 + s
            after |= picked[:, s, None] & ends_in[node]
            lay = np.where(picked[:, s], ends_at[node], lay)
        settled = np.array_equal(lay, ends_at) and np.array_equal(after, ends_in)
        ends_at, ends_in, rank = lay, after, finer
        if settled:
            break
    # The next node on the least audit: of those that its first edit leads to, the one of the least rank.
    onward = np.where(reach, rank.reshape(layers, 4)[layer], big)
    follow = layer * 4 + onward.argmin(axis=1)
    stops = stop.reshape(-1)
    entries = (begin[:, None] * 4 + np.arange(4)[None, :]).reshape(-1)
    path, jump = entries[:, None], follow
    while not stops[path[:, -1]].all():
        path = np.concatenate((path, jump[path]), axis=1)
        jump = jump[jump]
    names = np.frombuffer(LETTERS + b" ", np.uint8)
    told = names[np.where(stops, 4, first)][path]
    audits = [bytes(row).rstrip(b" ") for row in told]
    return [audits[4 * b : 4 * b + 4] for b in range(len(symbols))], (path[:, -1] % 4).reshape(-1, 4), d[begin]


def damaged(rows: DataFrame) -> DataFrame:
    """`key`, `turn`, `role`, `text` and `copies` of what is left of the rows (`conv_id`, `turn`, `role`, `text`) after the contract's damage."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    work = rows.select(conversation_key("conv_id").alias("key"), F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    return work.filter("draw <> 0").select("key", "turn", role.alias("role"), text.alias("text"), F.when(F.col("draw") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def conversation_key(name: str) -> Column:
    """A string that is never null and equal for equal ids only, null ones among them."""
    return F.coalesce(F.concat(F.lit("g"), F.col(name).cast("string")), F.lit(""))


ORDER = ["key", "known", "turn", "role", "h"]


def _rows(turns: DataFrame) -> DataFrame:
    """The order columns of every row, its text, and what can be told of it alone: initial, and fault unless it is a duplicate."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(CUT)
    name = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    return turns.select("key", F.col("turn").isNotNull().alias("known"), "turn", "role", name.alias("h"), code.alias("initial"), fault.alias("fault"), "copies", "text")


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of up to `BLOCK` rows of a conversation in order: their symbols, where each row begins, cost matrix, and counts.

    Range partitions follow each other, so (`part`, `at`) orders the blocks of a conversation.
    """
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    fields = ["part", "at", "key", "symbols", "rows", "matrix", "blank", "duplicate", "truncated", "illegal", "first", "last"]
    item = pa.struct([("n", pa.int32()), ("known", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.binary()), ("skip", pa.int64())])
    legal = np.zeros((4, 4), bool)
    for a, b in LEGAL:
        legal[a, b] = True

    def told(part, blocks):
        symbols = [np.frombuffer(bytes(b[2]), np.uint8).astype(np.int64) for b in blocks]
        initials = [s // 4 for s in symbols]
        count = lambda f: pa.array([int((s % 4 == f).sum()) for s in symbols], pa.int64())
        illegal = [int((~legal[i[:-1], i[1:]]).sum()) for i in initials]
        matrix = matrices(symbols).reshape(-1, 16)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(blocks), pa.int32()), pa.array([b[1] for b in blocks], pa.int64()), pa.array([b[0] for b in blocks], pa.string()), pa.array([bytes(b[2]) for b in blocks], pa.binary()),
                pa.array([b[3] for b in blocks], pa.list_(item)), pa.array(matrix.tolist(), pa.list_(pa.int64())), count(BLANK), count(DUPLICATE), count(CUT), pa.array(illegal, pa.int64()),
                pa.array([int(i[0]) for i in initials], pa.int32()), pa.array([int(i[-1]) for i in initials], pa.int32()),
            ],
            names=fields,
        )

    def run(batches):
        part, at, blocks = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for key, known, turn, role, h, initial, fault, copies in zip(*(batch.column(k).to_pylist() for k in range(8))):
                for skip in range(copies):
                    if not blocks or blocks[-1][0] != key or len(blocks[-1][2]) == BLOCK:
                        if len(blocks) == 256:
                            yield told(part, blocks)
                            blocks = []
                        blocks.append((key, at, bytearray(), []))
                        at += 1
                    _, _, symbols, rows = blocks[-1]
                    if skip == 0 or not rows:
                        rows.append({"n": len(symbols), "known": known, "turn": turn, "role": role, "h": h, "skip": skip})
                    symbols.append(initial * 4 + (fault if skip == 0 or fault == BLANK else DUPLICATE))
        if blocks:
            yield told(part, blocks)

    kind = "array<struct<n: int, known: boolean, turn: bigint, role: string, h: binary, skip: bigint>>"
    return ordered.select(*ORDER, "initial", "fault", "copies").mapInArrow(
        run, f"part int, at bigint, key string, symbols binary, rows {kind}, matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first int, last int"
    )


def _costs_behind(blocks: DataFrame) -> DataFrame:
    """`part`, `at`, `ends` (what is to pay behind the block), `final` (no block follows) and `border` (an illegal pair across its end)."""
    rows = blocks.select("key", "part", "at", "matrix", "first", "last").repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("at"))

    def run(batches):
        key, pay, follower = None, None, None
        for batch in batches:
            parts, ats, ends, final, border = [], [], [], [], []
            matrix = batch.column(3).flatten().to_numpy().reshape(-1, 4, 4)
            for k, part, at, m, first, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), matrix, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                fresh = k != key
                if fresh:
                    key, pay = k, END
                parts.append(part)
                ats.append(at)
                ends.append(pay.tolist())
                final.append(fresh)
                border.append(int(not fresh and (last, follower) not in LEGAL))
                pay, follower = np.minimum((m + pay).min(axis=1), INF), first
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array(ats, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(final, pa.bool_()), pa.array(border, pa.int64())],
                names=["part", "at", "ends", "final", "border"],
            )

    return rows.mapInArrow(run, "part int, at bigint, ends array<bigint>, final boolean, border bigint")


def _walked(blocks: DataFrame, behind: DataFrame) -> DataFrame:
    """Per block and entering state the least audit, the state it leaves in (`exits`), and what is to pay from nothing (`pay`)."""
    rows = blocks.select("part", "at", "key", "symbols", "rows").join(behind.select("part", "at", "ends", "final", "border"), ["part", "at"])
    rows = rows.select("part", "at", "key", "rows", "border", "symbols", "ends", "final")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = [np.frombuffer(s, np.uint8).astype(np.int64) for s in batch.column(5).to_pylist()]
            ends = batch.column(6).flatten().to_numpy().reshape(-1, 4)
            audits, exits, pay = least_audits(symbols, ends, np.asarray(batch.column(7).to_pylist(), bool))
            texts = [[a.decode() for a in four] for four in audits]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(texts, pa.list_(pa.string())), pa.array(exits.tolist(), pa.list_(pa.int32())), pa.array(pay[:, 0], pa.int64())],
                names=["part", "at", "key", "rows", "border", "audits", "exits", "pay"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:5])
    return rows.mapInArrow(run, f"{schema}, audits array<string>, exits array<int>, pay bigint")


def _entered(walked: DataFrame) -> DataFrame:
    """`part`, `at`, `entry` (the state in which the path enters the block) and `head` (it is the first of its conversation)."""
    rows = walked.select("key", "part", "at", "exits").repartition("key").sortWithinPartitions("key", "part", "at")

    def run(batches):
        key, state = None, 0
        for batch in batches:
            entry, head = [], []
            for k, exits in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                head.append(k != key)
                if k != key:
                    key, state = k, 0
                entry.append(state)
                state = exits[state]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(entry, pa.int32()), pa.array(head, pa.bool_())], names=["part", "at", "entry", "head"])

    return rows.mapInArrow(run, "part int, at bigint, entry int, head boolean")


def _written(told: DataFrame) -> DataFrame:
    """What the audits write, row by row: the order columns of the row, its role if it stays, and turns inserted before and behind it."""
    kind = f"key string, known boolean, turn bigint, role string, h binary, skip bigint, {'before string, stays string, behind string'}"
    name = {2: "user", 3: "assistant"}
    names = ["key", "known", "turn", "role", "h", "skip", "before", "stays", "behind"]
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            out = []
            for key, rows, audit, state in zip(*(batch.column(k).to_pylist() for k in range(4))):
                at = {r["n"]: r for r in rows}
                n, row, before = 0, rows[0], []
                for edit in audit:
                    if edit == "I":
                        state = NEEDED[state]
                        before.append(f"{name[state]}:")
                        continue
                    row = at.get(n, row)
                    stays = None
                    if edit != "D":
                        initial = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(row["role"][:1], OTHER)
                        state = NEXT[state][initial] if edit == "K" else NEEDED[state]
                        stays = row["role"] if edit == "K" else name[state]
                    if stays is not None or before:
                        skip = row["skip"] + n - row["n"]
                        out.append((key, row["known"], row["turn"], row["role"], row["h"], skip, "\n".join(before) if before else None, stays, None))
                        before = []
                    n += 1
                if before:
                    skip = row["skip"] + n - row["n"]
                    out.append((key, row["known"], row["turn"], row["role"], row["h"], skip, None, None, "\n".join(before)))
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return told.select("key", "rows", "audit", "entry").mapInArrow(run, kind)


def _once(rows: DataFrame) -> DataFrame:
    """The rows, repeated ones of a batch once: a crowd of equal rows travels as a few."""

    def run(batches):
        for batch in batches:
            seen, keep = set(), []
            for k, name in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if name not in seen:
                    seen.add(name)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def _digests(rows: DataFrame, written: DataFrame) -> DataFrame:
    """`key` and `sha`: the digest of each repaired conversation that is not empty.

    Texts and edits meet in the order of the rows. A conversation that lies inside one range partition is digested there; of one
    that crosses a border, or is larger than a chunk, chunks of text go on, in order.
    """
    texts = _once(rows.filter(F.col("fault") != BLANK).select(*ORDER, "text"))
    edits = ["skip", "before", "stays", "behind"]
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(edits, ("bigint", "string", "string", "string"))]
    both = texts.select(*ORDER, "text", *none).union(written.select(*ORDER, F.lit(None).cast("string").alias("text"), *edits))
    ordered = both.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, F.asc_nulls_first("skip"))
    names = ["key", "part", "at", "sha", "chunk"]

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        key, row, text = None, None, None
        lines, size, whole, first = [], 0, True, True

        def batch(sha, chunk):
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.string()), pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([sha], pa.string()), pa.array([chunk], pa.binary())], names=names
            )

        done = []
        for b in batches:
            for k, known, turn, role, h, value, skip, before, stays, behind in zip(*(b.column(c).to_pylist() for c in range(10))):
                if k != key:
                    if lines or not whole:
                        joined = "\n".join(lines).encode()
                        if whole and not first:
                            done.append((key, hashlib.sha256(joined).hexdigest()))
                        elif lines:
                            yield batch(None, joined)
                            at += 1
                    first = key is None
                    key, lines, size, whole = k, [], 0, True
                if (known, turn, role, h) != row or skip is None:
                    row, text = (known, turn, role, h), value
                if skip is None:
                    continue
                new = [x for x in (before, None if stays is None else f"{stays}:{text}", behind) if x is not None]
                lines += new
                size += sum(map(len, new))
                if size > CHUNK_BYTES:
                    yield batch(None, "\n".join(lines).encode())
                    at += 1
                    lines, size, whole = [], 0, False
            if done:
                n = len(done)
                ks, shas = zip(*done)
                done = []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ks, pa.string()), pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(shas, pa.string()), pa.array([None] * n, pa.binary())], names=names
                )
        if lines:
            yield batch(None, "\n".join(lines).encode())

    pieces = stored(ordered.mapInArrow(run, "key string, part int, at bigint, sha string, chunk binary"))
    chunks = pieces.filter("chunk is not null").select("key", "part", "at", "chunk").repartition("key").sortWithinPartitions("key", "part", "at")

    def finish(batches):
        key, state = None, None
        for b in batches:
            keys, shas = [], []
            for k, chunk in zip(b.column(0).to_pylist(), b.column(3)):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        shas.append(state.hexdigest())
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(chunk.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shas, pa.string())], names=["key", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["key", "sha"])

    return pieces.filter("sha is not null").select("key", "sha").union(chunks.mapInArrow(finish, "key string, sha string"))


def repair(turns: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of the turns (`key`, `turn`, `role`, `text`, `copies`).

    Rows stand by turn, null first; those of one turn by role and then by a digest of role and text, which is a defined order
    and no other. `copies` equal rows stand together. Nulls in role and text are not expected (`damaged` replaces them).
    """
    rows = _rows(turns)
    same = [*ORDER, "initial", "fault"]
    distinct = stored(rows.groupBy(*same).agg(F.sum("copies").alias("copies")))
    place = F.struct("known", "turn")
    seen = distinct.filter(F.col("fault") != BLANK).groupBy("key", "h").agg(F.min(place).alias("seen"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = F.coalesce(place > F.col("seen"), F.lit(False)) & (F.col("fault") != BLANK)
    marked = distinct.join(seen, ["key", "h"], "left").withColumn("fault", F.when(later, DUPLICATE).otherwise(F.col("fault")))
    blocks = stored(_blocks(marked))
    behind = _costs_behind(blocks)
    walked = stored(_walked(blocks, behind))
    told = walked.join(_entered(walked), ["part", "at"])
    told = stored(told.select("part", "at", "key", "rows", "border", "pay", "head", "entry", F.expr("audits[entry]").alias("audit")))
    pieces = F.array_sort(F.collect_list(F.struct("part", "at", "audit")))
    paths = told.groupBy("key").agg(
        F.sum(F.when(F.col("head"), F.col("pay"))).alias("cost"), F.sum("border").alias("border"), F.array_join(F.transform(pieces, lambda p: p.audit), "").alias("audit")
    )
    counts = blocks.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    by_turn = distinct.filter("known").select("key", "turn").distinct()
    gaps = by_turn.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = counts.join(paths, "key").join(gaps, "key", "left").join(_digests(rows, _written(told)), "key", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("key", number("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("border")).alias("illegal"), "cost", "audit", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation of the table what `repair` says of it after the contract's damage; one of which no row is left has zeros, an
    empty audit and the digest of nothing. A null id is a conversation, nulls in role and text are one space, in turn come first."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("key", conversation_key("conv_id"))
    out = every.join(found, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
