"""Connected components of a link table, by contraction.

Every round each node takes its smallest neighbour (or itself) as parent, parents are looked up
twice, and the links are rewritten between parents; links inside one parent vanish.  All state is
in written tables; a node with very many links costs one partial aggregate per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import written


def _relabel(df: DataFrame, col: str, parent: DataFrame) -> DataFrame:
    p = parent.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    return df.join(p, F.col(col) == F.col("_n"), "left").withColumn(col, F.coalesce("_p", col)).drop("_n", "_p")


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node in ``links`` (bigint columns ``a``, ``b``).

    ``component`` is the smallest node reachable.  Nodes without links are not listed.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("parent"))
        parent = written(parent, "parents")
        parent = written(_relabel(_relabel(parent, "parent", parent), "parent", parent), "parents")
        labels = (parent.withColumnRenamed("parent", "component") if labels is None
                  else _relabel(labels, "component", parent))
        labels = written(labels, "labels")
        links = written(_relabel(_relabel(links, "a", parent), "b", parent)
                        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .where("a <> b").distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
