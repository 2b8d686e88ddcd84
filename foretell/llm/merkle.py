"""A Merkle manifest of a table, with a proof for every row (operator 11): higher-order SQL blocks.

A leaf is the digest of a row's columns.  Leaves of a key ascend by an order; while several nodes remain, every `ARITY` consecutive ones become the digest of their concatenated hex digests, until a key has its subroot; the subroots, ordered by key, give the root in the same way.

Nodes are dealt to blocks of ARITY ** HEIGHT consecutive nodes of a key, one ordered array each.  Inside a block `sequence`, `transform`, `slice` and `aggregate` collapse HEIGHT levels at once (fewer where the block is all that its key has), and the roots of the blocks are the nodes of the next round, so a key of n leaves takes log(n) / log(729) rounds.  Proofs come down the same tables: a block's own siblings are put before those of its parent block, and the leaf level folds every proof inside its block, so no proof is ever shuffled for a single leaf.

Scale: texts are read once, and only digests go on.  Positions come from one range partitioning by (key, order) and a table of partition offsets, so a key may hold any share of the rows; blocks are bounded groups.  The driver sees one number a tree (the largest key, for the number of rounds).

Defined cases: a null column is `-` in the leaf; null keys are a key of their own, before all others; a null doc_id comes first and is never tampered with; rows that repeat an id are ordered by their leaf, and rows repeated whole are leaves each; empty texts have zero bytes; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.llm.common import discard, materialise

ARITY = 3
HEIGHT = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: `-` for a null, else byte count, `:` and value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def leaves(docs: DataFrame, key: str = "source", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None) -> DataFrame:
    """key, id, leaf and, where `changed` gives a column another value, changed_leaf (null where the leaf is the same)."""
    leaf = leaf_digest(*[F.col(c) for c in columns])
    if changed is None:
        other = F.lit(None).cast("string")
    else:
        differs = reduce(lambda a, b: a | b, [~v.eqNullSafe(F.col(c)) for c, v in changed.items()])
        other = F.when(differs, leaf_digest(*[changed.get(c, F.col(c)) for c in columns]))
    return docs.select(F.col(key).alias("key"), F.col(order).alias("id"), leaf.alias("leaf"), other.alias("changed_leaf"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (from 0 within their key, by `order`) and n (rows of the key).

    Range partitions are numbered in order, and within one the rows of a key are consecutive, so a row's position is its distance from the first of its key there plus the rows of earlier partitions.
    """
    numbered = materialise(rows.withColumn("tie", F.monotonically_increasing_id()))
    dealt = numbered.repartitionByRange(*[F.col(c).asc_nulls_first() for c in ("key", *order, "tie")]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("key", *order, "tie")])
    dealt = materialise(dealt.drop("tie").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    discard(numbered)
    by_key = Window.partitionBy("key")
    starts = dealt.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col("key").alias("_key"), F.col("part").alias("_part"), "first", before.alias("before"), F.sum("rows").over(by_key).alias("n"))
    placed = dealt.join(starts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")))
    return placed.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "_key", "_part", "first", "before")


def _collapse(nodes: Column) -> Column:
    """The next level of an array of nodes."""
    runs = F.ceil(F.size(nodes) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), ""), 256))


def _levels(nodes: Column, alone: Column, height: int) -> Column:
    """All levels of a block from its nodes to its root: `height` more than its own, or as many as it takes if the block is `alone`."""
    top = lambda levels: F.element_at(levels, -1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.array(nodes), lambda levels, _: F.when(alone & (F.size(top(levels)) == 1), levels).otherwise(F.concat(levels, F.array(_collapse(top(levels))))))


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """One row per block of nodes (key, pos, n, leaf, ...): key, block, n, members (ordered), levels."""
    width = ARITY**height
    carried = [c for c in nodes.columns if c not in ("key", "pos", "n")]
    rows = nodes.groupBy("key", F.floor(F.col("pos") / width).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *carried))).alias("members"))
    return rows.withColumn("levels", _levels(F.col("members.leaf"), F.col("n") <= width, height))


class Tree(NamedTuple):
    """The block tables of each round, and each key's root: key, leaf."""

    rounds: list[DataFrame]
    roots: DataFrame


def tree(nodes: DataFrame, height: int = HEIGHT) -> Tree:
    """The tree of every key of nodes (key, pos, n, leaf, ...), as written tables."""
    width, rounds = ARITY**height, []
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        rounds.append(materialise(_blocks(nodes, height)))
        root = F.element_at(F.element_at("levels", -1), 1).alias("leaf")
        nodes = rounds[-1].select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / width).cast("long").alias("n"), root)
        most = -(-most // width)
        if most <= 1:
            return Tree(rounds, nodes.select("key", "leaf"))


def _siblings(levels: Column, at: Column) -> Column:
    """For each level above a block's node number `at`: what stands left and right of its ancestor in its run, concatenated."""

    def of(level: Column) -> Column:
        node = F.floor(at / F.pow(F.lit(float(ARITY)), level)).cast("int")
        first = node - node % ARITY
        nodes = F.get(levels, level)
        side = lambda there: F.concat(*[F.when(there(first + k), F.coalesce(F.get(nodes, first + k), F.lit(""))).otherwise("") for k in range(ARITY)])
        return F.struct(side(lambda i: i < node).alias("left"), side(lambda i: i > node).alias("right"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), of)).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def _with_path(blocks: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """blocks with the path of their root: paths has key, pos, path, root."""
    above = paths.select(F.col("key").alias("_key"), F.col("pos").alias("_block"), "path", "subroot", "root")
    return blocks.join(above, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))).drop("_key", "_block")


def _paths(built: Tree, top: DataFrame, height: int, until: int) -> DataFrame:
    """key, pos, path, subroot and root of the nodes that round `until` of a tree starts from; top has the same of its roots, at pos 0."""
    for blocks in reversed(built.rounds[until:]):
        own = _with_path(blocks, top, height)
        steps = F.transform("members", lambda m, i: F.struct(m.pos.alias("pos"), F.concat(_siblings(F.col("levels"), i), F.col("path")).alias("path")))
        top = own.select("key", "subroot", "root", F.inline(steps))
    return top


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step.left, node, step.right), 256))


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per row of leaves(): key, id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    placed = positions(rows, ["id", "leaf"])
    keys = tree(placed, height)
    roots = keys.roots.withColumn("all", F.lit(0))
    placed_roots = positions(roots.select(F.lit(0).alias("key"), F.col("key").alias("name"), "leaf"), ["name"])
    whole = tree(placed_roots, height)
    root = whole.roots.select(F.col("key"), F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("leaf").alias("root"))
    above = _paths(whole, root.withColumn("subroot", F.lit(None).cast("string")), height, 0)
    names = placed_roots.select("pos", "name", F.col("leaf").alias("subroot"))
    above = above.drop("key", "subroot").join(names, "pos").select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    above = _paths(keys, materialise(above), height, 1)

    own = _with_path(keys.rounds[0], above, height)
    proven = F.transform(
        "members",
        lambda m, i: F.transform(
            F.array(F.concat(_siblings(F.col("levels"), i), F.col("path"))),
            lambda path: F.struct(
                m.id.alias("id"), m.leaf.alias("leaf"),
                F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256).alias("proof_sha256"),
                fold(F.coalesce(m.changed_leaf, m.leaf), path).alias("folded_root"),
            ),
        )[0],
    )
    out = own.select("key", "subroot", "root", F.inline(proven))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
