"""Merkle manifest of a dataset, with proofs from checkpoints and recomputed nodes.

Leaves are numbered in every tree (a tree per group value), ``fanout`` consecutive nodes of a level are hashed
into one of the next, and the trees' roots are the leaves of one more tree, whose root stands for the dataset.

Only every ``STRIDE``-th level is stored: a stored row is one aligned block, the ``fanout ** STRIDE`` (512)
consecutive nodes below one node of the next stored level.  The levels between exist nowhere: a block's
expression regenerates them from the stored nodes, once to go up (*build*) and once more to emit each node's
siblings (*proofs*), and drops them.  Proofs are extracted from the top down: a block's proof is its root's
proof, found in the level above, behind the siblings inside the block, so a path is put together once for
512 leaves and nothing larger than one block is ever in one row.

Numbers come from one range sort by (group, order columns): the written table holds each row's place in its
partition, and the partitions' counts (one row per partition and group) give the places before it.  Rows that
agree in all of these columns have equal leaves, so which of them comes first changes no digest; a salt
deals even a third of all rows that are equal to several partitions.  There is no window over a group and
no list longer than a block.

Defined results: NULL order values come first, repeated ones are ordered by their leaf; NULL is a group of
its own, the first; a tree of one leaf has that leaf as its root; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlens.llm.common import written

FANOUT, STRIDE = 8, 3
BLOCK = FANOUT ** STRIDE
#: siblings to the left and right of a node on its way up, as joined digests
_PATH = "array<struct<left:string,right:string>>"


def framed(*values: Column) -> Column:
    """The values as one text: ``-`` for NULL, else byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _runs(nodes: str) -> str:
    """SQL: the next level above an array of consecutive digests that starts a run."""
    return (f"transform(sequence(0, (size({nodes}) - 1) div {FANOUT}), "
            f"r -> sha2(array_join(slice({nodes}, {FANOUT} * r + 1, {FANOUT}), ''), 256))")


def _levels(block: DataFrame, nodes: str) -> DataFrame:
    """``up0 .. up3``: the levels inside each block; a tree that has come down to one node stays as it is."""
    out = block.withColumn("up0", F.expr(nodes))
    for level in range(STRIDE):
        many = f"level_nodes > {FANOUT ** level}"  # nodes of the whole tree at this level, more than one
        out = out.withColumn(f"up{level + 1}", F.expr(f"if({many}, {_runs(f'up{level}')}, up{level})"))
    return out


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (``tree``, ``leaf``, the ``order`` columns and others) with ``place`` in the tree from 0
    and ``level_nodes``, the tree's number of leaves."""
    salted = leaves.withColumn("_salt", F.rand(17))
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "leaf", "_salt")]
    placed = (salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
              .withColumn("_at", F.monotonically_increasing_id()))
    rows = written(placed.withColumn("_part", F.shiftright("_at", 33)), "merkle-leaves")
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    starts = counts.select(  # one row per partition of a tree
        F.col("tree").alias("t"), F.col("_part").alias("p"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("level_nodes"))
    return (rows.join(starts, rows["tree"].eqNullSafe(starts["t"]) & (rows["_part"] == starts["p"]))
            .withColumn("place", F.col("_at") + F.col("shift")).drop("_at", "_part", "t", "p", "shift"))


def _blocks(nodes: DataFrame, members: list[str]) -> DataFrame:
    """One row per aligned block of a stored level: its members in order of place, at most 512."""
    grouped = nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block"), "level_nodes").agg(
        F.sort_array(F.collect_list(F.struct("place", *members))).alias("members"))
    return grouped


def build(nodes: DataFrame, members: list[str]) -> list[DataFrame]:
    """The stored levels, from blocks of leaves up to one block per tree.

    ``nodes`` has ``tree``, ``place``, ``level_nodes``, ``leaf`` and further ``members`` columns.
    """
    stored = [written(_blocks(nodes, ["leaf", *members]), "merkle-level")]
    while True:
        level = stored[-1]
        most = level.agg(F.max("level_nodes")).first()[0]
        if most is None or most <= BLOCK:
            return stored
        above = _levels(level, "members.leaf").select(
            "tree", F.col("block").alias("place"), F.expr(f"(level_nodes + {BLOCK - 1}) div {BLOCK}").alias("level_nodes"),
            F.expr(f"up{STRIDE}[0]").alias("leaf"))
        stored.append(written(_blocks(above, ["leaf"]), "merkle-level"))


def roots(stored: list[DataFrame]) -> DataFrame:
    """``tree`` and its root digest as ``leaf``."""
    return _levels(stored[-1], "members.leaf").select("tree", F.expr(f"up{STRIDE}[0]").alias("leaf"))


def _siblings(level: int) -> str:
    """SQL: left and right siblings of member ``i``'s ancestor on a level inside the block."""
    at = f"(i div {FANOUT ** level})"
    run = f"slice(up{level}, {at} - {at} % {FANOUT} + 1, {FANOUT})"
    return (f"named_struct('left', array_join(slice({run}, 1, cast({at} % {FANOUT} as int)), ''), "
            f"'right', array_join(slice({run}, cast({at} % {FANOUT} + 2 as int), {FANOUT}), ''))")


def proofs(stored: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf's members with its ``path`` from the leaf up, and the columns of ``above``.

    ``above`` has a row per tree: ``tree``, the ``path`` of the tree's root, and columns passed through.
    """
    passed = [c for c in above.columns if c not in ("tree", "path")]
    up = above.withColumn("block", F.lit(0).cast("long"))
    rows = above
    for level in reversed(stored):
        upper = up.select(F.col("tree").alias("_t"), F.col("block").alias("_b"), "path", *passed)
        met = _levels(level, "members.leaf").join(
            upper, level["tree"].eqNullSafe(upper["_t"]) & (level["block"] == upper["_b"]))
        inside = ", ".join(_siblings(k) for k in range(STRIDE))
        # levels that the tree still has above this one: up to STRIDE of them are inside the block
        height = " + ".join(f"if(level_nodes > {FANOUT ** k}, 1, 0)" for k in range(STRIDE))
        each = F.expr(f"transform(members, (m, i) -> named_struct('m', m, 'path', "
                      f"concat(slice(array({inside}), 1, {height}), path)))")
        rows = met.select("tree", F.explode(each).alias("e"), *passed).select("tree", "e.m.*", "e.path", *passed)
        up = rows.withColumnRenamed("place", "block")
    return rows


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.expr(f"aggregate({path}, {leaf}, (node, s) -> sha2(concat(s.left, node, s.right), 256))")


def path_digest(path: str = "path") -> Column:
    """Digest of all siblings, from the leaf up and left to right."""
    return F.expr(f"sha2(array_join(transform({path}, s -> concat(s.left, s.right)), ''), 256)")


def forest(leaves: DataFrame, order: list[str], members: list[str]) -> DataFrame:
    """Every leaf with ``subroot`` (its tree's), ``root`` (of all trees' roots in order of ``tree``) and ``path``."""
    stored = build(numbered(leaves, order), members)
    trees = roots(stored).select(F.lit(0).alias("tree"), F.col("leaf"), F.col("tree").alias("name"))
    top = build(numbered(trees, ["name"]), ["name"])
    end = roots(top).select("tree", F.array().cast(_PATH).alias("path"), F.col("leaf").alias("root"))
    above = proofs(top, end).select(F.col("name").alias("tree"), "path", F.col("leaf").alias("subroot"), "root")
    return proofs(stored, above)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text",
             tampered: Column | None = None) -> DataFrame:
    """Leaf, roots and inclusion proof of every row, and whether a copy of the row leads to the root.

    ``tampered`` says of which rows the copy's text has A-Z lower-cased (NULL as false).  Returns ``id_col``, ``leaf``,
    ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.
    """
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    copy = [lower if f == text_col else F.col(f) for f in fields]
    leaves = docs.select(
        F.col(group_col).alias("tree"), F.col(id_col).alias("id"), digest(framed(*[F.col(f) for f in fields])).alias("leaf"),
        F.when(tampered, digest(framed(*copy))).alias("changed"))
    rows = forest(leaves, ["id"], ["id", "changed"])
    return (rows.withColumn("folded_root", folded("coalesce(changed, leaf)"))
            .select(F.col("id").alias(id_col), "leaf", "subroot", "root", path_digest().alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))
