"""Centroid clustering of integer vectors with expressions that stay in the JVM.

1. A vector's components become integers ``floor(scale * x)``; only vectors of exactly ``dims`` components,
   none of them NULL, NaN or infinite, are kept.
2. The starting centroids are the ``k`` kept vectors with the smallest salted hash of their id.
3. A round is one pass over the vectors: ``zip_with`` and ``aggregate`` compute the squared distance to each
   centroid of a literal array, ``array_min`` of (distance, number) structs chooses the cluster, and one
   aggregate sums every component as a column of its own.  Sums are combined in each task before the
   shuffle, so at most ``k`` rows a task move, and ``k`` rows of ``dims + 1`` numbers reach the driver
   however many vectors there are and however many of them are equal.
4. The last assignment is written once and read for the clusters' sums and for the result.

All arithmetic is on integers, so the result doesn't depend on the partitioning and reruns agree.  No vector
is moved between tasks.

Defined results: a NULL, shorter, longer or unclean vector has no row; ids may be NULL (hashed as the text
``null``) or repeated (one row per kept row; repeats may be starting centroids together); of equal hashes
the vector whose components come first goes first; with fewer than ``k`` kept vectors all of them are centroids; a
table without kept vectors gives an empty result; a cluster that has no vectors keeps its centroid; other columns
are ignored, whatever their names.  A component of more than 2**27 in size after scaling is an error, since
squared distances must fit a long.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import written

#: largest component after scaling: 64 * (2 * 2**27)**2 is below 2**63
_LARGEST = 2 ** 27


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """The kept vectors as ``id`` and ``x`` (array of ``dims`` longs)."""
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("raw"))
    unclean = F.exists("raw", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    clean = raw.where((F.size("raw") == dims) & ~unclean)

    def whole(v):
        scaled = F.floor(F.lit(float(scale)) * v)
        return F.when(F.abs(scaled) <= _LARGEST, scaled).otherwise(
            F.raise_error(F.lit("a vector component is too large for exact distances")).cast("long"))

    return clean.select("id", F.transform("raw", whole).alias("x"))


def _literal(centroids: list[list[int]]) -> Column:
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{v}L" for v in c) + ")" for c in centroids) + ")")


def nearest(centroids: list[list[int]]) -> Column:
    """``struct(distance, cluster)`` of the centroid nearest to ``x``; of equal distances the smaller number."""
    def distance(c):
        squares = F.zip_with("x", c, lambda p, q: (p - q) * (p - q))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, v: total + v)

    return F.array_min(F.transform(_literal(centroids), lambda c, i: F.struct(
        distance(c).alias("distance"), i.alias("cluster"))))


def first_centroids(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors whose ids hash lowest, at most ``k`` rows from any task."""
    text = F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    first = kept.select(F.sha2(text, 256).alias("h"), "x").orderBy("h", "x").limit(k)
    return [list(r.x) for r in first.collect()]


def updated(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid replaced by its vectors' mean, each component rounded down."""
    dims = len(centroids[0])
    sums = (kept.select(nearest(centroids)["cluster"].alias("cluster"), "x")
            .groupBy("cluster").agg(F.count(F.lit(1)).alias("n"),
                                    *[F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(dims)]))
    out = list(centroids)
    for row in sums.collect():  # at most one row per centroid
        out[row.cluster] = [row[f"s{j}"] // row.n for j in range(dims)]
    return out


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64,
                      k: int = 40, rounds: int = 5, scale: float = 256.0, salt: str = "2:") -> DataFrame:
    """One row per kept vector: ``id_col``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``,
    ``centroid_sha256``."""
    kept = integer_vectors(vectors, id_col, vec_col, dims, scale)
    centroids = first_centroids(kept, k, salt)
    for _ in range(rounds if centroids else 0):
        centroids = updated(kept, centroids)
    if not centroids:
        return kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[
            F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"))
    assigned = written(kept.select("id", nearest(centroids).alias("near")).select("id", "near.*"), "clusters")
    sums = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())  # at most k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = F.col("cluster")
    return assigned.select(
        F.col("id").alias(id_col), of, "distance",
        F.get(F.expr("array(" + ", ".join(f"{sums.get(i, 0)}L" for i in range(len(centroids))) + ")"), of)
        .alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.get(F.expr("array(" + ", ".join(f"'{d}'" for d in digests) + ")"), of).alias("centroid_sha256"))
