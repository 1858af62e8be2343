"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated at random and kept as the signs of its coordinates with one correction
factor, its inner product with its own code. Divided by that factor, the inner product of a rotated
query with the code is an unbiased estimate of that with the vector, and the factor bounds the error.
Pairs whose bound reaches the threshold are computed exactly, in double precision; no other is.

Exact copies are one class with a weight. The classes of a label meet in cells: several tables of
code prefixes, longer for larger labels, such that a pair at the threshold is missed by all tables
with a chance of less than `MISS`. A cell is compared in blocks of bounded size, so that a popular
label or cell is spread over tasks; a block gives link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import worker_store
from .components import components

# Vectors of a block, and classes that a cell is meant to hold.
BLOCK, CELL = 1024, 4096
# Chance that all tables miss a pair at the threshold.
MISS = 1e-5
# Standard errors between an estimate and its confidence bound.
ERRORS = 5.0
SEED = 20


def rotation(size: int) -> np.ndarray:
    """A random rotation, the same for all tasks."""
    known = worker_store("rotations")
    if size not in known:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
        known[size] = q * np.sign(np.diag(r))
    return known[size]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes of -1 and 1, and their correction factors."""
    rotated = unit @ rotation(unit.shape[1]).T
    code = np.where(rotated >= 0, 1.0, -1.0).astype(np.float32)
    return rotated.astype(np.float32), code, np.abs(rotated).sum(axis=1) / math.sqrt(unit.shape[1])


def upper_bounds(rotated: np.ndarray, code: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of the inner products of rotated queries (rows) with coded vectors (columns)."""
    size = rotated.shape[1]
    estimate = (rotated @ code.T) / (math.sqrt(size) * factor).astype(np.float32)
    error = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * (ERRORS / math.sqrt(max(size - 1, 1)))
    return estimate + error.astype(np.float32)


def tables_for(bits: int, threshold: float) -> int:
    """Tables of so many bits that miss a pair at the threshold with a chance below MISS."""
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - agree))


def hyperplanes(size: int, table: int, bits: int) -> np.ndarray:
    known = worker_store("hyperplanes")
    key = size, table, bits
    if key not in known:
        known[key] = np.random.default_rng([SEED, table]).standard_normal((62, size))[:bits]
    return known[key]


def cell_keys(unit: np.ndarray, table: int, bits: int) -> np.ndarray:
    """Prefix of the code of each vector under the rotation of a table."""
    sides = (unit @ hyperplanes(unit.shape[1], table, bits).T) >= 0
    return sides @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(unit), np.int64)


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest connected position of every position, by pointer jumping."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _places(classes: DataFrame, threshold: float) -> DataFrame:
    """(`label`, `size`, `table`, `cell`, `bits`, `cls`, `vector`, `weight`): every class in its cell of every table."""
    counts = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    # The number of bits follows the size of the label, continuously.
    bits = F.greatest(F.ceil(F.log2(F.col("n") / F.lit(CELL))), F.lit(0)).cast("int").alias("bits")
    sized = classes.join(counts.select(F.col("label").alias("l"), F.col("dim").alias("d"), bits), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    out = "label string, dim int, bits int, tab int, cell bigint, cls bigint, weight bigint, vector array<double>"

    def run(batches):
        for b in batches:
            dim, bits_of = np.asarray(b.column(1)), np.asarray(b.column(2))
            for d, k in sorted(set(zip(dim.tolist(), bits_of.tolist()))):
                rows = np.flatnonzero((dim == d) & (bits_of == k))
                part = b.take(pa.array(rows))
                unit = _unit(_matrix(part.column(5)))
                for table in range(tables_for(k, threshold)):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2), pa.array(np.full(len(rows), table, np.int32)), pa.array(cell_keys(unit, table, k)), part.column(3), part.column(4), part.column(5)],
                        names=["label", "dim", "bits", "tab", "cell", "cls", "weight", "vector"],
                    )

    return sized.select("label", "dim", "bits", "cls", "weight", "vector").mapInArrow(run, out)


def near_links(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of classes (`label`, `dim`, `cls`, `weight`, `vector`): link weights per class (`cls`, `links`), and edges of spanning forests (`a`, `b`)."""
    placed = stored(_places(classes, threshold))
    cell = ["label", "dim", "bits", "tab", "cell"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = placed.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # A block meets every block of its cell once: as the left side those from its own on, as the right side those before.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select(*cell, "cls", "weight", "vector", "block", other)
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def compare(table: pa.Table) -> pa.Table:
        first = {k: table[k][0].as_py() for k in ("dim", "bits", "tab", "lo", "hi")}
        cls, weight, block = (np.asarray(table[k]) for k in ("cls", "weight", "block"))
        unit = _unit(_matrix(table["vector"].combine_chunks()))
        order = np.argsort(cls)
        cls, weight, block, unit = cls[order], weight[order], block[order], unit[order]
        left, right = np.flatnonzero(block == first["lo"]), np.flatnonzero(block == first["hi"])
        rotated, code, factor = encode(unit)
        i_all, j_all = [], []
        for at in range(0, len(left), BLOCK):
            rows = left[at : at + BLOCK]
            i, j = np.nonzero(upper_bounds(rotated[rows], code[right], factor[right]) >= threshold)
            i, j = rows[i], right[j]
            if first["lo"] == first["hi"]:
                i, j = i[i < j], j[i < j]
            exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            i_all.append(i[exact])
            j_all.append(j[exact])
        i, j = np.concatenate([*i_all, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*j_all, np.zeros(0, np.int64)]).astype(np.int64)
        # A pair counts in the first table whose cell it shares.
        fresh = np.ones(len(i), bool)
        for t in range(first["tab"]):
            keys = cell_keys(unit, t, first["bits"])
            fresh &= keys[i] != keys[j]
        i, j = i[fresh], j[fresh]
        links = np.bincount(i, weights=weight[j], minlength=len(cls)) + np.bincount(j, weights=weight[i], minlength=len(cls))
        root = _roots(len(cls), i, j)
        some = np.flatnonzero((links > 0) | (root != np.arange(len(cls))))
        return pa.table({"cls": cls[some], "links": links[some].astype(np.int64), "root": cls[root[some]]})

    found = stored(rows.groupBy(*cell, "lo", "hi").applyInArrow(compare, "cls bigint, links bigint, root bigint"))
    return found.groupBy("cls").agg(F.sum("links").alias("links")), found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """`id`, `n_links` (other rows linked directly), `component_id` (smallest id reachable by links, itself included) and `kept`.

    Rows are linked if their labels are equal and not null, their vectors equally long, and the cosine is
    at least the threshold. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Repeated rows are copies of each other and linked. Ids may repeat, each row then has its own links; a null id
    names a component only where no other id does. Other columns are not read.
    """
    values = F.col("v")
    usable = F.col("label").isNotNull() & values.isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Copies are one class. Ids may be null or repeat, so classes have numbers of their own; minus zero is zero.
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    content = F.sha2(F.concat_ws(",", F.col("label"), F.lit("|"), F.to_json(plain)), 256)
    rows = stored(rows.withColumn("content", F.when(F.col("usable"), content)))
    classes = rows.filter("usable").groupBy("content").agg(
        F.min("id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("vector"), F.first(F.size("v")).alias("dim")
    )
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()))
    links, edges = near_links(classes, threshold)
    comp = components(edges)
    of_class = classes.join(links, "cls", "left").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(
        "content", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")
    )
    of_class = stored(of_class)
    named = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(named, "component").select("content", "n_links", "component_id")
    out = rows.select("id", "content").join(of_class, "content", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
