"""Merkle manifest of a table: a tree of digests per group, a tree over the groups' roots, and a proof for every row.

Leaves are ranked within their group without bringing a group to one task.  Runs of ``BLOCK`` consecutive leaves are blocks.
Within a block the digits of the rank are grouped away, the last one first: each grouping gathers the children that
differ in that digit only, folds their digests ``BITS`` levels up and nests the children in the result.  So a
block ends as one row that holds its part of the tree, and a transform followed by an explode gives every leaf its way
up; leaves are never joined.  Roots of blocks are the leaves of the next tier, which is treated alike; only its rows, one per
block, meet the blocks again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.frames import settle, store

#: Levels folded by one grouping, and groupings of a block: a block has (2 ** BITS) ** DIGITS leaves.
BITS, DIGITS = 4, 3
RADIX = 1 << BITS
BLOCK = RADIX**DIGITS
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row within it below
WAY = "array<struct<sibling: string, left: boolean>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def record_digest(*values: Column) -> Column:
    """Digest of a record; no two different records have the same encoding."""
    return digest(F.concat(*[field(v) for v in values]))


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves(tree, key, hash, ...)`` with ``place`` from 0 and ``total`` within the tree, by key (nulls first), then hash.

    Rows are range partitioned and sorted; a row's place is its position in its partition and tree plus the rows of that tree in
    earlier partitions.  These counts are one row per partition and tree at most.  Equal rows may take each other's place.
    """
    order = [F.col("tree").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("hash")]
    placed = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = settle(placed.withColumn("_at", at).withColumn("_part", F.shiftright("_at", _ROW_BITS)))
    sizes = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy("tree")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("tree").alias("_tree"),
        F.col("_part").alias("_of"),
        (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(group).alias("total"),
    )
    same = (F.col("_part") == F.col("_of")) & F.col("tree").eqNullSafe(F.col("_tree"))
    joined = placed.join(store(offsets), same).withColumn("place", F.col("_at") + F.col("_shift"))
    return joined.drop("_at", "_part", "_tree", "_of", "_shift")


def height(total: Column) -> Column:
    """Levels above the leaves of a tree: the binary digits of the last leaf's place."""
    return F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)


def paired(nodes: Column) -> Column:
    """The next level: every two consecutive nodes' digest, a last one's alone."""
    each = F.sequence(F.lit(0), (F.size(nodes) - 1).cast("int").bitwiseAND(~1), F.lit(2))
    return F.transform(each, lambda i: digest(F.concat(F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.lit("")))))


def folded(nodes: Column, levels: Column) -> Column:
    """``nodes`` and the ``levels`` levels above them, as an array of arrays."""
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda have, _: F.concat(have, F.array(paired(F.element_at(have, -1)))))


def blocks(nodes: DataFrame) -> DataFrame:
    """``(tree, block, total, hash, levels, kids)`` from ``nodes(tree, place, total, hash, item)``: a row per block.

    ``levels`` are the topmost levels of the block, ``kids`` the nested children below them.  All groupings need the one
    shuffle by tree and block.
    """
    digit = lambda d: F.shiftright("place", BITS * d).bitwiseAND(RADIX - 1).cast("int").alias(f"d{d}")
    current = nodes.select(
        "tree", F.shiftright("place", BITS * DIGITS).alias("block"), "total", *[digit(d) for d in range(DIGITS)], "hash",
        F.struct("item").alias("inside"),
    )
    # A null tree is a tree of its own; its rows go by their block like all others.
    current = current.repartition("tree", "block")
    for d in range(DIGITS):
        keys = ["tree", "block", "total", *[f"d{x}" for x in range(DIGITS - 1, d, -1)]]
        child = F.struct(F.col(f"d{d}").alias("digit"), "hash", "inside")
        kids = current.groupBy(*keys).agg(F.array_sort(F.collect_list(child)).alias("kids"))
        levels = F.least(F.lit(BITS), F.greatest(F.lit(0), height(F.col("total")) - BITS * d))
        up = folded(F.transform("kids", lambda k: k.hash), levels)
        current = kids.withColumn("levels", up).select(
            *keys, F.element_at(F.element_at("levels", -1), 1).alias("hash"), F.struct("levels", "kids").alias("inside")
        )
    return current.select("tree", "block", "total", "hash", "inside.*")


def siblings(levels: Column, digit: Column) -> Column:
    """What a child needs to reach the top of ``levels``: per level its sibling (empty if it has none) and its side."""
    steps = F.when(F.size(levels) > 1, F.sequence(F.lit(0), F.size(levels) - 2)).otherwise(F.array().cast("array<int>"))

    def step(k: Column) -> Column:
        at = F.call_function("shiftright", digit, k)
        other = F.coalesce(F.get(F.get(levels, k), at.bitwiseXOR(1)), F.lit(""))
        return F.struct(other.alias("sibling"), (at.bitwiseAND(1) == 1).alias("left"))

    return F.transform(steps, step)


def ways(block_rows: DataFrame) -> DataFrame:
    """``(item, hash, way, top)`` of every leaf of ``blocks`` rows that have the block's own ``way`` and ``top``."""

    def under(kids: Column, levels: Column, above: Column, depth: int) -> Column:
        def child(k: Column) -> Column:
            way = F.concat(siblings(levels, k.digit), above)
            if depth == 1:
                return F.array(F.struct(k.inside.item.alias("item"), k.hash.alias("hash"), way.alias("way")))
            return under(k.inside.kids, k.inside.levels, way, depth - 1)

        return F.flatten(F.transform(kids, child))

    leaf = F.explode(under(F.col("kids"), F.col("levels"), F.col("way"), DIGITS)).alias("leaf")
    return block_rows.select("tree", "top", leaf).select("tree", "leaf.*", "top")


def folded_root(start: Column, way: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    join = lambda have, s: digest(F.when(s.left, F.concat(s.sibling, have)).otherwise(F.concat(have, s.sibling)))
    return F.aggregate(way, start, join)


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The stored tiers of ``blocks`` over ``leaves(tree, key, hash, item)``; the last one has a row per tree, with its root.

    There are as many tiers as the largest tree needs; each has a row for 4,096 of the tier below.
    """
    nodes, tiers = ranked(leaves).select("tree", "place", "total", "hash", "item"), []
    while True:
        tiers.append(store(blocks(nodes)))
        if (tiers[-1].agg(F.max("block")).first()[0] or 0) == 0:
            return tiers
        up = F.shiftright(F.col("total") - 1, BITS * DIGITS) + 1
        nodes = tiers[-1].select("tree", F.col("block").alias("place"), up.alias("total"), "hash", F.struct("block").alias("item"))


def descend(tiers: list[DataFrame], roots: DataFrame) -> DataFrame:
    """``ways`` of all leaves of the lowest tier; ``roots`` are the rows of the last tier with their own ``way`` and ``top``."""
    top = roots
    for lower in reversed(tiers[:-1]):
        way = ways(top).select(F.col("tree").alias("_tree"), F.col("item.block").alias("_block"), "way", "top")
        same = (F.col("block") == F.col("_block")) & F.col("tree").eqNullSafe(F.col("_tree"))
        top = lower.join(store(way), same).drop("_tree", "_block")
    return ways(top)


def manifest(leaves: DataFrame) -> DataFrame:
    """``(item, leaf, subroot, root, way)`` of every row of ``leaves(tree, key, hash, item)``.

    Within a tree leaves ascend by key (null first, ties by digest); while several nodes remain, every two consecutive ones become
    the digest of their hexadecimal texts, a last single one its own.  The roots of the trees, ascending by tree (null first),
    become the root likewise.  ``way`` holds the siblings from the leaf to the root.  A lone leaf is its tree's root, a lone
    tree's root the root; no rows give no rows.  Repeated rows are leaves of their own.
    """
    inner = climb(leaves)
    subroots = inner[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("key"), "hash", F.struct("tree").alias("item"))
    outer = climb(subroots)
    above = descend(outer, outer[-1].withColumns({"way": F.array().cast(WAY), "top": F.col("hash")}))
    above = store(above.select(F.col("item.tree").alias("_tree"), "way", F.col("top").alias("_root")))
    roots = inner[-1].join(above, F.col("tree").eqNullSafe(F.col("_tree")))
    roots = roots.withColumn("top", F.struct(F.col("hash").alias("subroot"), F.col("_root").alias("root"))).drop("_tree", "_root")
    return descend(inner, roots).select("item", F.col("hash").alias("leaf"), "top.subroot", "top.root", "way")


def document_manifest(
    docs: DataFrame,
    tampered: Column,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof, folded_root, verified)`` of every document, a tree per language.

    ``columns`` name the id, source, language, length and text.  ``tampered`` is a condition on ``doc_id``: where it holds (null: no),
    one is added to the length (null stays null) after the manifest was made, and ``folded_root`` starts from the changed
    record.  ``proof`` is the concatenation of the siblings from the leaf to the root.
    """
    key, source, lang, size, text = (F.col(c) for c in columns)
    held = docs.select(
        key.cast("long").alias("doc_id"), source.cast("string").alias("source"), lang.cast("string").alias("lang"),
        size.cast("long").alias("size"), text.cast("string").alias("text"),
    )
    record = lambda n: record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    changed = F.when(tampered & F.col("size").isNotNull(), record(F.col("size") + 1))
    leaves = held.select(
        F.col("lang").alias("tree"), F.col("doc_id").alias("key"), record(F.col("size")).alias("hash"),
        F.struct("doc_id", changed.alias("changed")).alias("item"),
    )
    made = manifest(leaves).withColumn("folded_root", folded_root(F.coalesce("item.changed", "leaf"), F.col("way")))
    return made.select(
        "item.doc_id", "leaf", "subroot", "root",
        F.array_join(F.transform("way", lambda s: s.sibling), "").alias("proof"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
