"""First-wins removal of repeats: by key, and by vector similarity. Both are exact.

The vector form is the answer of a walk over the rows in order: a row stays if it resembles nothing known and no row
kept before it. It is found in passes over a stretch at the front of what is undecided. A stretch of one block is walked
by one task. A longer one is decided by a round: a row that no undecided earlier row resembles stays. Either way all that
resembles a row that stays goes, wherever it stands, and the rest is the input of the next pass. Stretches double while
most of their rows stay, else they are a block again: rows that resemble many cost a few passes, rows that resemble
nothing a number of passes that grows with their logarithm, and chains of likes two passes a block at most.

Who resembles whom is asked block against rows in tasks. Rows are dealt to the nearest of a few pivots; two cells
meet only where the angle between their pivots, less their radii, leaves the threshold possible. No pair is written:
a task returns the rows of its block that have an answer. The rows asked lie in one block each, only the answers are
copied, to each block they may meet, and so few at a time that the copies stay within a small multiple of all rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import discard, stored

# Questions of one scan of `nearest_known`.
BATCH = 4096
# Rows of a block, and so of what one task holds of the rows asked; also those of the longest stretch that one task walks.
BLOCK = 16384
# Blocks of wide vectors have fewer rows: as many as are this large as doubles.
BLOCK_BYTES = 32 << 20
# Answers dealt at a time, in blocks.
SCAN = 2
# Pivots at most, and so the cells that rows are dealt into; there are no more than blocks, as every cell is a block at least.
PIVOTS = 64
# Shares of a block that rows are cut into by order; stretches are made of them.
CUTS = 4


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest `order` per key. Pre-aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def _matrix(column) -> np.ndarray:
    """A list column of vectors as a matrix of doubles; shorter vectors and null components are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = np.nan_to_num(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), posinf=np.inf, neginf=-np.inf)
    sizes = np.asarray(pc.coalesce(pc.list_value_length(column), 0))
    width = int(sizes.max())
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products, each over the shorter length."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width] @ b[:, :width].T


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(`id`, `embedding`, `cell`, `angle`, `norm`): every row at its nearest pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors
    key = rows.schema["id"].dataType.simpleString()

    def place(batches):
        at = shared.value
        length = np.maximum(np.linalg.norm(at, axis=1), 1e-300)
        for b in batches:
            vectors = _matrix(b.column(1))
            if not len(vectors):
                continue
            norm = np.linalg.norm(vectors, axis=1)
            cosine = _products(vectors, at) / np.maximum(norm, 1e-300)[:, None] / length
            cell = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(norm)], names=["id", "embedding", "cell", "angle", "norm"])

    vector = rows.schema["embedding"].dataType.simpleString()
    return rows.select("id", "embedding").mapInArrow(place, f"id {key}, embedding {vector}, cell int, angle double, norm double")


def _cells(placed: DataFrame) -> list:
    """One row per cell: its rows, radius and longest vector."""
    return placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"), F.max("norm").alias("norm")).collect()


def _meetings(left: list, right: list, pivots: np.ndarray, threshold: float, batch: int) -> list[tuple[int, int, int]]:
    """Cells that can hold a pair at the threshold, with the left one's number of blocks; at most as many as pairs of pivots."""
    length = np.maximum(np.linalg.norm(pivots, axis=1), 1e-300)
    between = np.arccos(np.clip(_products(pivots, pivots) / length[:, None] / length, -1, 1))
    out = []
    for x in left:
        for y in right:
            least = max(0.0, between[x.cell, y.cell] - x.radius - y.radius - 1e-6)
            bound = np.cos(min(least, np.pi)) * x.norm * y.norm
            if bound + 1e-9 >= threshold or (bound < 0 and threshold <= 0):
                out.append((x.cell, y.cell, -(-x.rows // batch)))
    return out


def _near(left: DataFrame, right: DataFrame, pivots: np.ndarray, threshold: float, batch: int, earlier: bool = False) -> DataFrame:
    """`id` of the placed rows on the left that a placed row on the right resembles, stored, some of them more than once.

    With `earlier` only a row with a smaller id counts.
    """
    spark = left.sparkSession
    key = left.schema["id"].dataType.simpleString()
    theirs = _cells(right)
    meetings = _meetings(_cells(left), theirs, pivots, threshold, batch)
    if not meetings:
        return spark.createDataFrame([], f"id {key}")
    met = F.broadcast(spark.createDataFrame(meetings, "lc int, rc int, blocks int"))  # pairs of pivots
    own = F.broadcast(spark.createDataFrame(sorted({(c, blocks) for c, _, blocks in meetings}), "lc int, blocks int"))  # pivots
    digest = F.xxhash64("id", "embedding")
    asked = left.join(own, F.col("cell") == F.col("lc")).select("lc", F.pmod(digest, F.col("blocks")).cast("int").alias("li"), F.lit(0).alias("side"), "id", "embedding")

    def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        mine = np.asarray(table["side"]) == 0
        vectors = _matrix(table["embedding"])
        asked, answers = np.flatnonzero(mine), np.flatnonzero(~mine)
        if earlier:
            rank = np.unique(table["id"].to_numpy(), return_inverse=True)[1]  # a row on both sides has one rank
        found = np.zeros(len(asked), bool)
        for a in range(0, len(answers), 1024):
            some, still = answers[a : a + 1024], np.flatnonzero(~found)
            against = vectors[some]
            for k in range(0, len(still), 4096):
                at = still[k : k + 4096]
                near = _products(vectors[asked[at]], against) >= threshold
                if earlier:
                    near &= rank[some][None, :] < rank[asked[at]][:, None]
                found[at] = near.any(axis=1)
        return pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(pa.array(asked[found]))], names=["id"])

    def run(batches):
        waiting, now = [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(k)) for k in range(2)], axis=1)
            first = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip((0, *first), (*first, len(keys))):
                if a == b:
                    continue
                if waiting and tuple(keys[a]) != now:
                    yield told(waiting)
                    waiting = []
                now = tuple(keys[a])
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield told(waiting)

    scans = -(-sum(x.rows for x in theirs) // (SCAN * batch))
    found = None
    for k in range(scans):
        some = right.filter(F.pmod(digest, F.lit(scans)) == k).join(met, F.col("cell") == F.col("rc"))
        some = some.select("lc", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("li"), F.lit(1).alias("side"), "id", "embedding")
        rows = asked.unionByName(some).repartition("lc", "li").sortWithinPartitions("lc", "li")
        part = stored(rows.mapInArrow(run, f"id {key}"))
        found = part if found is None else found.unionByName(part)
    return found


def _walked(rows: DataFrame, threshold: float) -> DataFrame:
    """The placed rows that a walk over them by id keeps, in one task. Rows with one id stay or go together."""

    def walk(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        ids, vectors = table["id"].combine_chunks(), _matrix(table["embedding"])
        new = np.asarray(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False), bool)
        owner = np.concatenate(([0], np.cumsum(new)))  # the number of a row's id
        first = np.flatnonzero(np.concatenate(([True], new, [True])))  # where each begins, and the end
        gone = np.zeros(len(first) - 1, bool)
        a = 0
        while a < len(gone):
            b = max(a + 1, int(np.searchsorted(first, first[a] + 1024, "right")) - 1)  # ids of up to 1,024 rows, or one
            rows = np.arange(first[a], first[b])
            rows = rows[~gone[owner[rows]]]
            if b > a + 1:
                mine = owner[rows]
                near = _products(vectors[rows], vectors[rows]) >= threshold
                for j, x in enumerate(mine):
                    if not gone[x]:
                        gone[mine[near[j] & (mine > x)]] = True
                rows = rows[~gone[mine]]
            later = np.arange(first[b], len(owner))
            for k in range(0, len(rows), 1024):
                against = vectors[rows[k : k + 1024]]
                later = later[~gone[owner[later]]]
                for n in range(0, len(later), 4096):
                    at = later[n : n + 4096]
                    gone[owner[at[(_products(vectors[at], against) >= threshold).any(axis=1)]]] = True
            a = b
        yield from table.filter(pa.array(~gone[owner])).combine_chunks().to_batches()

    return rows.repartition(1).sortWithinPartitions("id").mapInArrow(walk, rows.schema)


def keep_first_wins(
    incoming: DataFrame, known: DataFrame | None, threshold: float, order: str = "id", batch: int = BLOCK
) -> DataFrame:
    """Drop incoming rows similar to a known one or to an incoming one kept before it.

    `embedding` holds unit vectors; rows without one, or with a zero vector,
    resemble nothing and stay. Blocks have about `batch` rows, fewer of wide vectors.
    """
    comparable = F.coalesce(vx.dot("embedding", "embedding") >= threshold, F.lit(False))
    rest = incoming.filter(~comparable)
    # Exact copies collapse first: only the earliest of them can survive. Rows without an id are nobody's first.
    waiting = first_of_each(incoming.filter(comparable & F.col(order).isNotNull()).select(order, "embedding"), ["embedding"], order)
    waiting = stored(waiting.select(F.col(order).alias("id"), "embedding"))
    rows, width = waiting.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not rows:
        return rest
    batch = max(1, min(batch, BLOCK_BYTES // max(8, 8 * width)))
    pivots = _matrix(waiting.orderBy(F.xxhash64("id")).limit(max(1, min(PIVOTS, rows // batch))).toArrow().column("embedding"))
    # Rows with one id are in one cut.
    left = stored(_placed(waiting.repartitionByRange(-(-CUTS * rows // batch), "id"), pivots).withColumn("cut", F.spark_partition_id()))
    discard(waiting)

    def without(df: DataFrame, others: DataFrame) -> DataFrame:
        found = _near(df, others, pivots, threshold, batch)
        out = stored(df.join(found, "id", "left_anti"))
        discard(found)
        return out

    if known is not None:
        nameless = F.lit(None).cast(left.schema["id"].dataType).alias("id")
        # Copies of a vector would all lie in one share.
        seen = stored(_placed(known.filter("embedding is not null").select("embedding").distinct().select(nameless, "embedding"), pivots))
        before, left = left, without(left, seen)
        discard(before, seen)
    chosen, most = [], batch
    while cuts := sorted(map(tuple, left.groupBy("cut").count().collect())):  # CUTS numbers for a block of rows
        ends = np.cumsum([n for _, n in cuts])
        last = max(0, int(np.searchsorted(ends, most, "right")) - 1)
        head, later = (left.filter(F.col("cut") <= cuts[last][0]), left.filter(F.col("cut") > cuts[last][0]))
        used = [left]
        if ends[last] <= batch:
            kept, over = stored(_walked(head, threshold)), last + 1 == len(cuts)
        else:
            held = _near(head, head, pivots, threshold, batch, earlier=True)
            kept, undecided = (stored(head.join(held, "id", how)) for how in ("left_anti", "left_semi"))
            later, over = later.unionByName(undecided), False
            used += [held, undecided]
        chosen.append(kept.select("id"))
        if over:
            discard(*used)
            break
        most = 2 * most if 2 * kept.count() >= ends[last] else batch
        left = without(later, kept)
        discard(*used)
    if not chosen:
        return rest
    chosen = reduce(DataFrame.unionByName, chosen).withColumnRenamed("id", order)
    return incoming.join(chosen, order, "left_semi").select(*incoming.columns).unionByName(rest)


def nearest_known(
    new: DataFrame, known: DataFrame, threshold: float = 0.86, top: int = 3, batch: int = BATCH
) -> DataFrame:
    """For every new row: up to `top` known rows at or above the threshold, best first.

    The new rows are asked in blocks of about `batch`, one scan of the known table each. A partition keeps
    the best `top` per new row and reports nothing else, so the ranking shuffle is small.
    """
    asked = new.filter("embedding is not null").select("id", "embedding")
    blocks = -(-asked.count() // batch) or 1
    block = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(blocks))
    out = None
    for k in range(blocks):
        part = _nearest(asked.filter(block == k).toArrow(), new, known, threshold, top)
        if blocks > 1:
            part = stored(part)
        out = part if out is None else out.unionByName(part)
    return out


def _best(rows: pa.Table, top: int) -> pa.Table:
    """The first `top` rows of each question, by score and then id."""
    rows = rows.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
    q = rows["q"].to_numpy()
    first = np.searchsorted(q, q)
    return rows.take(pa.array(np.flatnonzero(np.arange(len(q)) - first < top)))


def _nearest(questions: pa.Table, new: DataFrame, known: DataFrame, threshold: float, top: int) -> DataFrame:
    """`nearest_known` for one block of questions."""
    from .ordering import top_per

    new_type = new.schema["id"].dataType.simpleString()
    known_type = known.schema["id"].dataType.simpleString()
    ids = questions["id"].to_pylist()
    shared = known.sparkSession.sparkContext.broadcast(_matrix(questions["embedding"]))  # one block

    def scan(batches):
        best = None
        for part in batches:
            for at in range(0, part.num_rows if ids else 0, 2048):
                some = part.slice(at, 2048)
                scores = _products(_matrix(some.column(1)), shared.value)
                # One more than wanted, as a row is no answer to itself; and all that tie with the last.
                last = max(0, len(scores) - top - 1)
                floor = np.maximum(np.partition(scores, last, axis=0)[last], threshold)
                row, q = np.nonzero(scores >= floor[None, :])
                found = pa.table({"q": q, "id": some.column(0).take(pa.array(row)), "score": scores[row, q]})
                same = [ids[i] == x for i, x in zip(q, found["id"].to_pylist())]
                found = found.filter(pa.array(np.logical_not(same), pa.bool_()))
                best = _best(found if best is None else pa.concat_tables([best, found]), top)
        if best is not None and best.num_rows:
            asked = pa.array([ids[i] for i in best["q"].to_pylist()], questions.schema.field("id").type)
            yield from pa.table({"new_id": asked, "id": best["id"], "score": best["score"]}).combine_chunks().to_batches()

    found = known.filter("embedding is not null").select("id", "embedding")
    hits = found.mapInArrow(scan, f"new_id {new_type}, id {known_type}, score double")
    return top_per(hits, ["new_id"], [F.col("score").desc(), F.col("id")], top)
