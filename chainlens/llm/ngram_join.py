"""Near-duplicate classes by an exact Jaccard self-join on word shingles.

The join is a sparse product of the document x shingle incidence matrix with its transpose, kept
small by bounds that follow from the set sizes alone (t = percent / 100):

* column order: shingles are hashed to ``2**BLOCK_BITS`` column blocks, the entries of every block
  are counted over all documents, and each row lists its shingles from the lightest block to the
  heaviest, so passages that many documents share come last;
* row prefix: two sets with Jaccard >= t share one of their first ``n - ceil(t n) + 1`` shingles in
  that order (any common order is exact), so only this prefix enters the product;
* size bound: sizes must not differ by more than the factor t;
* overlap bound: with ``c`` common prefix shingles the overlap is at most
  ``c + max(n_a - p_a, n_b - p_b)``; pairs that can't reach ``t / (1 + t) (n_a + n_b)`` are dropped,
  most of them before they are formed.

Equal sets are one row of the matrix.  A column's rows are never paired with each other at once
(:mod:`chainlens.llm.pivots`): pivots first, then exactly the rows that pivots left apart.  Overlaps
are accumulated by counting, pairs below the bounds are discarded, and the others are compared by
their whole sets, so no link between different sets is lost.

Shingles are 64-bit fingerprints (:mod:`chainlens.llm.common`).

Defined results: a NULL or empty text has no shingles and is a component alone; a row with NULL id
gets a NULL component and links nothing; rows repeated with one id and text share their class, and an
id given to different texts links them where it is the smallest id of both; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import (discard, key_filter, may_be_wanted, shingle_fingerprints,
                                  ship, text_chunks, text_or_empty, word_fingerprints, written)
from chainlens.llm.pivots import pivot_classes, shared_rows

BLOCK_BITS = 18
_SHIFT = np.uint64(64 - BLOCK_BITS)


def _sets(batch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row in the batch, its distinct shingles in ascending order)``."""
    for first, data, offsets in text_chunks(batch.column("text")):
        words, starts = word_fingerprints(data, offsets)
        shingles, cut = shingle_fingerprints(words, starts, size)
        for d in range(len(offsets) - 1):
            yield first + d, np.unique(shingles[cut[d]:cut[d + 1]])


def _block_loads(size: int):
    def count(batches):
        load = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
        for b in batches:
            for _, s in _sets(b, size):
                np.add.at(load, (s >> _SHIFT).astype(np.int64), 1)
        used = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(load[used], pa.int64())],
                                         ["block", "load"])

    return count


def prefix_length(n, percent: int):
    """Shingles of a set of ``n`` that enter the product (also for NumPy and Column arguments)."""
    return n - (n * percent + 99) // 100 + 1


def _prefixes(size: int, percent: int, loads: np.ndarray):
    def rows(batches):
        for b in batches:
            ns, digests, cut, keys = [], [], [0], []
            for _, s in _sets(b, size):
                ns.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    order = np.argsort(loads[(s >> _SHIFT).astype(np.int64)], kind="stable")
                    keys.append(s[order[:prefix_length(len(s), percent)]])
                cut.append(cut[-1] + (len(keys[-1]) if len(s) else 0))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))],
                ["id", "text_hash", "n", "digest", "prefix"])

    return rows


def _whole_sets(size: int, wanted: np.ndarray):
    def rows(batches):
        for b in batches:
            b = b.filter(may_be_wanted(wanted, b.column("id")))
            out = [s.tobytes() for _, s in _sets(b, size)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "shingles"])

    return rows


def _overlaps(batches: Iterable) -> Iterator:
    for b in batches:
        inter, union = [], []
        for x, y in zip(b.column("set_a"), b.column("set_b")):
            s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            k = len(np.intersect1d(s, t, assume_unique=True))
            inter.append(k)
            union.append(len(s) + len(t) - k)
        yield pa.RecordBatch.from_arrays(
            [b.column("a"), b.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())],
            ["a", "b", "inter", "union"])


def _needed(n_a, n_b, percent: int):
    """Prefix shingles that two sets of these sizes must share to be similar enough."""
    rest = F.greatest(n_a - _prefix(n_a, percent), n_b - _prefix(n_b, percent))
    return F.greatest(F.ceil((n_a + n_b) * percent / (100 + percent) - 1e-9) - rest, F.lit(1))


def _prefix(n, percent: int):
    return n - F.ceil(n * percent / 100) + 1


class _Verifier:
    """Compares pairs by their whole sets, which are made once for each row that needs them."""

    def __init__(self, rows: DataFrame, size: int, percent: int):
        self.rows = rows.where("id is not null")
        self.size, self.percent, self.tables = size, percent, []

    def __call__(self, pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            return pairs
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        for have in self.tables:
            ids = ids.join(have.select("id"), "id", "left_anti")
        ids = written(ids, "ids")
        if not ids.isEmpty():
            sets = self.rows.mapInArrow(_whole_sets(self.size, key_filter(ids)), "id bigint, shingles binary")
            # rows that only share a slot with a wanted one go, so that no row is in two tables
            self.tables.append(written(sets.join(ids, "id", "left_semi"), "sets"))
        sets = reduce(DataFrame.union, self.tables, self.rows.sparkSession.createDataFrame([], "id long, shingles binary"))
        whole = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
                 .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b"))
        found = whole.select("a", "b", "set_a", "set_b").mapInArrow(
            _overlaps, "a bigint, b bigint, inter bigint, `union` bigint")
        return found.where(F.col("inter") * 100 >= F.col("union") * self.percent).select("a", "b")


def ngram_jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                          percent: int = 80) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable by links),
    ``text_hash`` (xxhash64 of the text).

    Two rows link when ``100 * intersection >= percent * union`` of their ``size``-word shingle sets.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    counted = rows.mapInArrow(_block_loads(size), "block int, load bigint").groupBy("block").agg(F.sum("load"))
    loads = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
    for block, load in counted.collect():  # at most 2**BLOCK_BITS rows
        loads[block] = load
    schema = "id bigint, text_hash bigint, n bigint, digest binary, prefix array<bigint>"
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    matrix = written(hashed.mapInArrow(_prefixes(size, percent, loads), schema), "matrix")

    named = matrix.where("n > 0 and id is not null")
    classes = written(named.groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "classes")
    entries = (named.join(classes, (named["digest"] == classes["digest"]) & (named["id"] == classes["rep"]), "left_semi")
               .select(F.col("id").alias("node"), F.col("n").cast("int").alias("n"), F.explode("prefix").alias("key")))
    product = shared_rows(entries)
    heads = written(matrix.select("id", "text_hash", "n", "digest"), "heads")
    discard(matrix)  # the prefixes are in the product now
    found = pivot_classes(
        product,
        written(classes.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n")), "sizes"),
        lambda a, b: _needed(a, b, percent),
        lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent,
        _Verifier(rows, size, percent))
    final = (classes.join(found, F.col("rep") == F.col("node"), "left")
             .select("digest", F.coalesce("component", "rep").alias("component")))
    return (heads.join(final, "digest", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), "text_hash"))
