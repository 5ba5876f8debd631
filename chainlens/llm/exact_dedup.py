"""Exact deduplication through an extendible-hash index (DataFrame operations only).

The key of a text is its 64-bit hash.  The index is built from one *entry* per distinct text:
equal texts are combined before the shuffle (``GROUP BY key, text`` compares the bytes), so a group
of copies costs one row per map task however large it is, and different texts with one key form a
chain of entries.  A directory addresses the entries by the leading bits of the key; an overfull
bucket is split by doubling the directory (one more bit) until it fits or no bits are left.  The
entries are then written bucket by bucket to the shared folder, each owner task holding one range of
keys.  A row is looked up through the index: the directory gives the bucket of its key, the key its
chain in the bucket, and the SHA-256 its entry in the chain.

A bucket's capacity follows from the number of entries (a 64th of them, at most 1,000,000 and at least 16), so
the directory has doubled several times on small and large tables alike.

Defined results: a NULL text counts as empty; ids may be NULL (the largest non-NULL id stays, a
group without any id keeps its NULL ids); rows repeated with the same id and text stay or go
together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import text_or_empty, written

MAX_DEPTH = 63


def _prefix(depth):
    return F.expr(f"shiftrightunsigned(key, 64 - {depth})") if depth else F.lit(0).cast("long")


def bucket_directory(keys: DataFrame, capacity: int, start_depth: int = 1) -> DataFrame:
    """Directory of an extendible hash over ``keys`` (column ``key``).

    One row per bucket: ``depth`` (bits in use), ``prefix`` (their value), ``entries``.  Buckets
    above ``capacity`` are split by one bit per round; keys that agree in all bits stay together.
    """
    depth, pending, leaves = start_depth, keys.select("key"), []
    while True:
        counts = written(pending.groupBy(_prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("entries")),
                         "directory")
        full = (F.col("entries") > capacity) if depth < MAX_DEPTH else F.lit(False)
        leaves.append(counts.where(~full).select(F.lit(depth).alias("depth"), "prefix", "entries"))
        overfull = counts.where(full)
        if overfull.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        pending = pending.withColumn("prefix", _prefix(depth)).join(overfull.select("prefix"), "prefix", "left_semi")
        depth += 1


#: share of the entries that a bucket holds, and the bounds of that number
_BUCKETS, _LEAST, _MOST = 64, 16, 1_000_000


def routed(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """``rows`` (with ``key``) and the ``depth`` and ``prefix`` of the bucket that the directory names for the key."""
    depths = sorted(r["depth"] for r in directory.select("depth").distinct().collect())  # at most MAX_DEPTH values
    if not depths:
        return rows.select("*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")).where("false")
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths])
    # a key has one bucket: at every other depth its prefix is an inner node or below a bucket
    return rows.select("*", F.explode(tries).alias("_b")).select(*rows.columns, "_b.*").join(
        directory.select("depth", "prefix"), ["depth", "prefix"])


def build_index(rows: DataFrame, capacity: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the index of ``rows`` (columns ``id``, ``text``): ``(directory, entries)``.

    Columns of the entries: ``depth``, ``prefix`` (the bucket), ``key``, ``sha256``, ``chain`` (entries with this
    key), ``keep_id``, ``group_size``.
    """
    entries = (rows.select(F.xxhash64("text").alias("key"), "text", "id")
               .groupBy("key", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .select("key", F.sha2("text", 256).alias("sha256"), "keep_id", "group_size"))
    entries = written(entries, "entries")
    if capacity is None:
        capacity = min(max(entries.count() // _BUCKETS, _LEAST), _MOST)
    directory = bucket_directory(entries, capacity)
    placed = routed(entries, directory)
    chains = placed.groupBy("key").agg(F.count(F.lit(1)).alias("chain")).where("chain > 1")
    placed = placed.join(chains, "key", "left").withColumn("chain", F.coalesce("chain", F.lit(1).cast("long")))
    return directory, written(
        placed.select("depth", "prefix", "key", "sha256", "chain", "keep_id", "group_size")
        .repartitionByRange("key").sortWithinPartitions("key", "sha256"), "hash-index", path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``bucket_depth``.

    Of equal texts the row with the largest id stays.  ``capacity`` is the number of index entries
    per bucket (by default sized from their number; it changes no result).
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    directory, index = build_index(rows, capacity)
    index = index.select("depth", "prefix", "key", F.col("sha256").alias("text_sha256"), "keep_id", "group_size")
    # never NULL by its type: the join needs no NULL filter, which would compute the hash again
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    probes = rows.select("id", F.xxhash64("text").alias("key"), digest.alias("text_sha256"))
    # the bucket first, the chain in it, the entry in the chain
    return routed(probes, directory).join(index, ["depth", "prefix", "key", "text_sha256"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", F.col("depth").alias("bucket_depth"))
