"""Classes of a similarity join over an inverted table, without pairing a column's rows with each other.

The table has a row for each (key, node): nodes that may be linked share a key.  Nodes are first
compared with *pivots* only.  A key's pivot is its most central node, that whose keys have the most
rows; every node is compared with the one pivot it shares most keys with, and that joins most near
copies into components, however many there are.  A few more rounds with other pivots follow for the
nodes left apart.  Then the rest, completely: a node whose component differs from that of a key's
pivot is paired with the key's nodes in other components.  A pair that must share ``c`` keys is
found at the first of them in a common order (rarest key first), which for both nodes is among all
but the last ``c - 1`` of the keys they share with anyone; other places aren't looked at.  The common
keys of the pairs found are then counted.  So every pair that shares enough keys either ends in one
component without being looked at, or is judged; pairs are about as many as the table's rows unless
many nodes share many keys without being similar.  For those a caller can give sketches of the nodes
left, from which the join sees that a pair can't be similar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlens.llm.common import discard, written
from chainlens.llm.components import connected_components

ROUNDS = 3


def shared_rows(entries: DataFrame) -> DataFrame:
    """The rows of ``entries`` (``key``, ``node``, ``n``) whose key at least two nodes have, with the number of ``rows``."""
    columns = (entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("low"),
                                          F.max("node").alias("high")).where("low <> high").select("key", "rows"))
    return written(entries.join(columns, "key"), "product")


def _replaced(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``new`` written, and ``old``, which it was made from, deleted."""
    table = written(new, name)
    discard(old)
    return table


def _labelled(df: DataFrame, labels: DataFrame, col: str, name: str) -> DataFrame:
    s = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return df.join(s, F.col(col) == F.col("_n"), "left").withColumn(name, F.coalesce("_c", col)).drop("_n", "_c")


def _merged(labels: DataFrame | None, more: DataFrame) -> DataFrame:
    """``labels`` after the components of links between their components."""
    if labels is None:
        return more
    known = labels.union(more.select("node", F.col("node").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component"))
    return written(_labelled(known, more, "component", "top").select("node", F.col("top").alias("component")), "labels")


def pivot_classes(product: DataFrame, sizes: DataFrame | None, needed: Callable[[Column, Column], Column],
                  similar_sizes: Callable[[Column, Column], Column], verified: Callable[[DataFrame], DataFrame],
                  sketches: Callable[[DataFrame], DataFrame] | None = None,
                  close: Callable[[Column, Column], Column] | None = None, known: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` of all nodes with links; ``component`` is the smallest node.

    ``product``: :func:`shared_rows`, without repeated rows, deleted once it is read; ``sizes``: ``node``, ``n`` (None
    if no pair depends on them); ``known``: links (``a``, ``b``) found before, which may be the only ones of their nodes; ``needed(n_a, n_b)``
    is the least number of common keys of a similar pair (1 or more), ``similar_sizes(n_a, n_b)`` says
    whether the sizes allow one, and ``verified`` returns the similar ones of pairs (``a``, ``b``).
    ``sketches`` gives (``node``, ``sketch``) of a table of ``node``, and ``close`` says whether two sketches
    allow a similar pair; it must hold for every similar pair.
    """
    # every row with its node's weight (how many rows the node meets in all its keys), the number of keys
    # the node shares with anyone, and the key's place among them
    own = Window.partitionBy("node")
    rows = written(product.select(
        "key", "node", "n", F.sum("rows").over(own).alias("weight"), F.count(F.lit(1)).over(own).alias("held"),
        F.row_number().over(own.orderBy("rows", "key")).alias("place"), F.col("node").alias("own")), "weighted")
    discard(product)
    labels = None
    if known is not None:
        found = connected_components(known)
        if not found.isEmpty():
            labels = found
            rows = _replaced(rows, _labelled(rows.drop("own"), labels, "node", "own"), "labelled")
    for k in range(ROUNDS):
        # the first time the heaviest node of a key, then pseudo-random ones
        first = F.struct("weight", (-F.col("node")).alias("x")) if k == 0 else F.struct(
            F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("x"))
        pivots = rows.groupBy("key").agg(F.max(F.struct(first.alias("p"), "node", "own")).alias("t")).select(
            "key", F.col("t.node").alias("pivot"), F.col("t.own").alias("main"))
        met = rows.join(pivots, "key").where("own <> main")
        shared = met.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
        nearest = shared.groupBy("node").agg(F.max(F.struct("c", "pivot", "n")).alias("best")).select("node", "best.*")
        # ``c`` may miss keys here; what this leaves out is met again below
        near = nearest.withColumn("np", F.col("n")) if sizes is None else nearest.join(
            sizes.select(F.col("node").alias("pivot"), F.col("n").alias("np")), "pivot")
        near = near.where(
            (F.col("c") >= needed(F.col("n"), F.col("np"))) & similar_sizes(F.col("n"), F.col("np")))
        links = verified(near.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        if labels is not None:
            links = _labelled(_labelled(links, labels, "a", "ca"), labels, "b", "cb").select(
                F.col("ca").alias("a"), F.col("cb").alias("b"))
        found = connected_components(links)
        if found.isEmpty():
            labels = found if labels is None else labels
            break  # what is left to find is found below
        labels = _merged(labels, found)
        rows = _replaced(rows, _labelled(rows.drop("own"), labels, "node", "own"), "labelled")
    pivots = rows.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("x"), "own")).alias("t")).select(
        "key", F.col("t.own").alias("main"))
    rows = _replaced(rows, rows.drop("weight").join(pivots, "key"), "labelled")
    if sketches is None:
        rows, close = rows.withColumn("sketch", F.lit(True)).withColumn("keys", F.lit(None)), lambda a, b: F.lit(True)
    else:
        # only keys that a stray has lead to pairs
        left = rows.where("own <> main").select("key").distinct()
        rows = _replaced(rows, rows.join(left, "key", "left_semi"), "strays")
        of = sketches(written(rows.select("node").distinct(), "nodes"))
        held = rows.groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most those of one node's prefix
        rows = _replaced(rows, rows.join(of, "node").join(held, "node"), "sketched")
    strays = rows.where("own <> main").select(
        "key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("own").alias("cx"),
        (F.col("held") - F.col("place") + 1).alias("leftx"), F.col("sketch").alias("sx"),
        F.col("keys").alias("hx"))
    # with few keys a pair is met at the smallest one of those it shares; at each, one of the two is a stray
    once = F.lit(True) if sketches is None else F.col("_key") == F.array_min(F.array_intersect("hx", "keys"))
    need = needed(F.col("nx"), F.col("n"))
    met = strays.join(rows.withColumn("_key", F.col("key")), "key").where(
        (F.col("own") != F.col("cx")) & ((F.col("own") == F.col("main")) | (F.col("x") < F.col("node")))
        & similar_sizes(F.col("nx"), F.col("n")) & close(F.col("sx"), F.col("sketch"))
        # from here on, this key included, both have keys enough left
        & (F.col("leftx") >= need) & (F.col("held") - F.col("place") + 1 >= need) & once)
    pairs = met.select("x", F.col("node").alias("y"), "nx", F.col("n").alias("ny")).distinct()
    keys = rows.groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most those of one node's prefix
    pairs = (pairs.join(keys.select(F.col("node").alias("x"), F.col("keys").alias("kx")), "x")
             .join(keys.select(F.col("node").alias("y"), F.col("keys").alias("ky")), "y"))
    rest = pairs.where(F.size(F.array_intersect("kx", "ky")) >= needed(F.col("nx"), F.col("ny")))
    links = verified(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = _labelled(_labelled(links, labels, "a", "ca"), labels, "b", "cb").select(F.col("ca").alias("a"),
                                                                                    F.col("cb").alias("b"))
    found = connected_components(links)
    discard(rows)
    return labels if found.isEmpty() else _merged(labels, found)
