"""A Merkle manifest of a table by bitmap ranks and slot arrays.

Every row is a leaf; the leaves of a group (a source) stand in the order of an integer key. Where a leaf
stands is not found by sorting them: the keys of a group are a bitmap, kept as its 64-bit words that are not zero
and merged from the parts of all tasks, and directories over it count the leaves before each word,
each block of 2^16 keys, 2^32 and 2^48. A leaf's place is what the directories say and the bits below its own in
its word. Node k of a level then goes to slot k mod 16 of array k div 16, keyed by group and
array, and each array's digest is a node of the next level. Arrays are kept, and on the way
back down every node hands the digests beside it to the 16 below.

No task holds more than 2^16 rows of a directory, 64 keys of a word or 16 slots, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from ..session import stored

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A null key stands before all others, in a word of its own below that of any 64-bit number.
NO_WORD = -(1 << 60)


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: list[Column]) -> Column:
    """The digest of a row: of each value its length in UTF-8 bytes, a colon and itself, or `-` for null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def _ordered(group: Column) -> Column:
    """A string that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("g"), group.cast("string")), F.lit(""))


def _directory(words: DataFrame) -> DataFrame:
    """`words` (`grp`, `word`, `n`) and `before`: leaves of the group in smaller words."""
    levels, at = [words.withColumn("up", F.expr("shiftright(word, 10)"))], "word"
    for shift in (16, 16, None):
        below = levels[-1].groupBy("grp", F.col("up").alias("at")).agg(F.sum("n").alias("n"))
        levels.append(below.withColumn("up", F.lit(0).cast("bigint") if shift is None else F.expr(f"shiftright(at, {shift})")))
    # Entries of one directory: at most 2^16 under the same `up` (and one for null).
    inside = [d.withColumn("inside", F.sum("n").over(W.partitionBy("grp", "up").orderBy(at if k == 0 else "at")) - F.col("n")) for k, d in enumerate(levels)]
    total = inside[-1].select("grp", F.col("at").alias("up"), F.col("inside").alias("base"))
    for d in inside[-2:0:-1]:
        total = d.join(total, ["grp", "up"]).select("grp", F.col("at").alias("up"), (F.col("inside") + F.col("base")).alias("base"))
    return inside[0].join(total, ["grp", "up"]).withColumn("before", F.col("inside") + F.col("base")).drop("inside", "base", "up")


def placed(rows: DataFrame) -> DataFrame:
    """Every row (`grp`, `id`, `leaf`, ...) once, as often as it occurs, with `pos`: how many leaves of its group stand before it.

    Equal rows are counted before they travel. Rows of one group with the same id stand in the order of their leaves.
    """
    extra = [c for c in rows.columns if c not in ("grp", "id", "leaf")]
    word = F.coalesce(F.expr("shiftright(id, 6)"), F.lit(NO_WORD))
    bit = F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    distinct = stored(rows.groupBy("grp", "id", "leaf", *extra).agg(F.count("*").alias("copies")).withColumn("word", word).withColumn("bit", bit))
    ids = distinct.groupBy("grp", "word", "bit").agg(F.sum("copies").alias("n"), F.count("*").alias("kinds"))
    ids = stored(ids)
    more = F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more")))
    words = ids.groupBy("grp", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.sum("n").alias("n"), F.collect_list(more).alias("more"))
    words = _directory(words)
    # Different leaves under one id: their order within, by blocks of the digest's first four characters.
    several = distinct.join(ids.filter("kinds > 1").select("grp", "word", "bit"), ["grp", "word", "bit"])
    several = several.withColumn("block", F.substring("leaf", 1, 4))
    of_id = ["grp", "word", "bit"]
    blocks = several.groupBy(*of_id, "block").agg(F.sum("copies").alias("n"))
    blocks = blocks.withColumn("base", F.sum("n").over(W.partitionBy(*of_id).orderBy("block")) - F.col("n")).drop("n")
    within = F.sum("copies").over(W.partitionBy(*of_id, "block").orderBy("leaf")) - F.col("copies")
    ties = several.withColumn("within", within).join(blocks, [*of_id, "block"]).select(*of_id, "leaf", (F.col("base") + F.col("within")).alias("tie"))
    rank = F.expr(
        "before + bit_count(bits & ~shiftleft(-1L, bit)) + aggregate(filter(more, m -> m.bit < bit), 0L, (s, m) -> s + m.more) + coalesce(tie, 0L)"
    )
    asked = distinct.join(words.drop("n"), ["grp", "word"]).join(ties, [*of_id, "leaf"], "left")
    return asked.select("grp", "id", "leaf", *extra, F.explode(F.sequence(rank, rank + F.col("copies") - 1)).alias("pos"))


def _grow(nodes: DataFrame, largest: int, extra: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Slot arrays of every level, and the nodes of every level that are alone in their group.

    Nodes are (`grp`, `pos`, `h`, `n`): the number of nodes that the group has on their level; the lowest ones have `extra` columns.
    """
    arrays, alone = [], [nodes.filter("n = 1")]
    while largest > 1:
        slot = F.struct(F.expr(f"int(pos % {ARITY})").alias("slot"), "h", *(extra if not arrays else []))
        groups = nodes.filter("n > 1").groupBy("grp", F.expr(f"pos div {ARITY}").alias("pos")).agg(F.array_sort(F.collect_list(slot)).alias("slots"), F.first("n").alias("n"))
        groups = stored(groups)
        arrays.append(groups)
        up = F.sha2(F.array_join(F.transform("slots", lambda s: s.h), ""), 256)
        nodes = groups.select("grp", "pos", up.alias("h"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
        alone.append(nodes.filter("n = 1"))
        largest = -(-largest // ARITY)
    return arrays, alone


PATH = "array<struct<l: string, r: string>>"


def _descend(arrays: list[DataFrame], alone: list[DataFrame], about: DataFrame, extra: list[str]) -> DataFrame:
    """The lowest nodes with their `path`: the digests left and right of each node on the way to the root, and the columns of `about` (`grp`, `path`, ...)."""
    more = [c for c in about.columns if c not in ("grp", "path")]
    top = alone[-1].join(about, "grp")
    for level in range(len(arrays) - 1, -1, -1):
        own = extra if level == 0 else []
        over = top.select("grp", "pos", "path", *more)
        beside = lambda test: F.expr(f"array_join(transform(filter(slots, s -> {test}), s -> s.h), '')")
        below = arrays[level].join(over, ["grp", "pos"]).select("grp", "pos", "slots", "path", *more, F.explode("slots").alias("me"))
        step = F.struct(beside("s.slot < me.slot").alias("l"), beside("s.slot > me.slot").alias("r"))
        below = below.select(
            "grp", (F.col("pos") * ARITY + F.col("me.slot")).alias("pos"), F.col("me.h").alias("h"), F.concat(F.array(step), F.col("path")).alias("path"), *more, *[F.col(f"me.{c}").alias(c) for c in own]
        )
        root = alone[level].join(about, "grp").select("grp", "pos", "h", "path", *more, *own)
        top = below.unionByName(root)
    return top


def manifest(docs: DataFrame, fields=FIELDS, group: str = "source", order: str = "doc_id", claimed: dict[str, Column] | None = None) -> DataFrame:
    """Per row `id`, `leaf`, `subroot`, `root`, `path` (digests left and right of it on every level, up to the root), and `claim`: the leaf with
    the `claimed` values in place of its own, null where they change nothing.

    Rows of a group stand by `order`, an integer column, null first; those with equal values by their leaves, equal rows in any
    order. Groups stand by name (UTF-8 bytes), null first; a null group is one, and so is that of the empty name. Nulls in
    any field, empty and long texts only enter digests. An empty table has no rows and no root. Other columns do
    not matter.
    """
    own = leaf([F.col(f"`{c}`") for c in fields])
    other = leaf([(claimed or {}).get(c, F.col(f"`{c}`")) for c in fields])
    rows = docs.select(_ordered(F.col(f"`{group}`")).alias("grp"), F.col(f"`{order}`").cast("bigint").alias("id"), own.alias("leaf"), other.alias("claim"))
    rows = rows.withColumn("claim", F.when(F.col("claim") != F.col("leaf"), F.col("claim")))
    leaves = stored(placed(rows))
    sizes = stored(leaves.groupBy("grp").agg(F.count("*").alias("n")))
    extra = ["id", "claim"]
    nodes = leaves.join(sizes, "grp").select("grp", "pos", F.col("leaf").alias("h"), "n", *extra)
    arrays, alone = _grow(nodes, sizes.agg(F.max("n")).first()[0] or 0, extra)
    subroots = alone[0].select("grp", "h")
    for more in alone[1:]:
        subroots = subroots.unionByName(more.select("grp", "h"))
    # The groups are the leaves of one more tree.
    numbered = stored(dense_index(subroots, "grp", "at"))
    groups = numbered.count()
    upper = numbered.select(F.lit("").alias("grp"), (F.col("at") - 1).alias("pos"), "h", F.lit(groups).cast("bigint").alias("n"), F.col("grp").alias("of"))
    joints, tops = _grow(upper, groups, ["of"])
    root = tops[-1].select("grp", F.col("h").alias("root")).withColumn("path", F.lit(None).cast(PATH))
    root = root.withColumn("path", F.coalesce("path", F.expr(f"cast(array() as {PATH})")))
    about = _descend(joints, tops, root, ["of"])
    about = stored(about.select(F.col("of").alias("grp"), "path", F.col("h").alias("subroot"), "root"))
    return _descend(arrays, alone, about, extra).select("id", F.col("h").alias("leaf"), "subroot", "root", "path", "claim")


def proof(path: str = "path") -> Column:
    """The digest of all digests beside the way to the root, from the lowest level up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p.l, p.r)), ""), 256)


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and the digests beside its way lead to."""
    return F.aggregate(path, start, lambda h, p: digest(p.l, h, p.r))


def report(docs: DataFrame) -> DataFrame:
    """Per document: its leaf, subroot, root and proof, and the root that a leaf tampered with leads to."""
    text = F.col("text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    out = manifest(docs, claimed={"text": F.when(tampered, F.translate(text, UPPER, LOWER)).otherwise(text)})
    out = out.withColumn("folded_root", folded(F.coalesce("claim", "leaf")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
