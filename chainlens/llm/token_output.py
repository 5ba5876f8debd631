"""Token ids in an entropy-coded file format, written in id order and decoded in parallel.

Documents are range-partitioned by id and sorted, so the files in name order hold ascending ids.
Inside a partition documents are encoded and gathered into segments of about ``segment_tokens``
ids (a longer document makes a longer segment).  One Parquet row is one segment: the ids and token
counts of its documents, the frequency table all its blocks share, and the blocks with their
checkpoints and checksums (:mod:`chainlens.llm.rans`).  A segment decodes from its own row alone.

Defined results: a NULL text is empty and holds only the end id; documents with a NULL id come
first; rows repeated with one id are all written, in the order of their texts' hashes; an empty
table makes a file set without segments; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlens.llm import rans, tokens
from chainlens.llm.common import shared_path, ship, text_or_empty

_FILE = ("part int, segment int, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, symbols binary, "
         "frequencies binary, blocks array<struct<n:bigint,words:binary,states:binary,offsets:array<bigint>,"
         "crc32:bigint>>")
_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_tokens", pa.list_(pa.int64())), ("symbols", pa.binary()), ("frequencies", pa.binary()),
    ("blocks", pa.list_(pa.struct([("n", pa.int64()), ("words", pa.binary()), ("states", pa.binary()),
                                   ("offsets", pa.list_(pa.int64())), ("crc32", pa.int64())])))])
_BATCH_CHARS = 4 << 20


def _segments(tokenizer: str, end_id: int, segment_tokens: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches):
        task = TaskContext.get()
        part = task.partitionId()
        enc = tokens.stage_encoder(tokenizer, task.stageId())
        number, ids, parts, held = 0, [], [], 0

        def segment():
            symbols = np.frombuffer(b"".join(parts), dtype="<u4")
            present, freq = rans.frequency_table(symbols)
            row = {"part": part, "segment": number, "n_tokens": len(symbols), "doc_ids": ids,
                   "doc_tokens": [len(p) // 4 for p in parts], "symbols": present.astype("<u4").tobytes(),
                   "frequencies": freq.astype("<u4").tobytes(), "blocks": rans.encode(symbols, present, freq)}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for b in batches:
            keys, texts, i = b.column("id").to_pylist(), b.column("text"), 0
            while i < len(keys):
                some, size = [], 0
                while i + len(some) < len(keys) and size < _BATCH_CHARS:
                    some.append(texts[i + len(some)].as_py())
                    size += len(some[-1])
                for key, raw in zip(keys[i:i + len(some)], enc.encode(some)):
                    ids.append(key)
                    parts.append(raw + end)
                    held += len(raw) // 4 + 1
                    if held >= segment_tokens:
                        yield segment()
                        number, ids, parts, held = number + 1, [], [], 0
                i += len(some)
        if ids:
            yield segment()

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", segment_tokens: int = 2_000_000) -> None:
    """Write the ids of every document, each followed by ``end_id``, to ``path``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    # the text's hash and a salt deal rows with NULL or one repeated id to several partitions
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("salt", F.rand(17))
    keys = [F.col("id").asc_nulls_first(), F.col("h"), F.col("salt")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    ordered.mapInArrow(_segments(tokenizer, end_id, segment_tokens), _FILE).write.mode("overwrite").parquet(path)


def _decoded(batches):
    tokens.forget()
    for b in batches:
        out = {"part": [], "segment": [], "doc_tokens": [], "befores": [], "crcs": [], "ids": []}
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            symbols = rans.decode(row["blocks"], np.frombuffer(row["symbols"], dtype="<u4"),
                                  np.frombuffer(row["frequencies"], dtype="<u4")).astype("<u4")
            cut = np.concatenate([[0], np.cumsum(row["doc_tokens"])]).tolist()
            raw = memoryview(symbols.tobytes())
            out["part"].append(row["part"])
            out["segment"].append(row["segment"])
            out["ids"].append(row["doc_ids"])
            out["doc_tokens"].append(row["doc_tokens"])
            out["befores"].append(cut[:-1])
            out["crcs"].append([zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(cut, cut[1:])])
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(out["part"], pa.int32()), "segment": pa.array(out["segment"], pa.int32()),
            "doc_ids": pa.array(out["ids"], pa.list_(pa.int64())),
            "doc_tokens": pa.array(out["doc_tokens"], pa.list_(pa.int64())),
            "befores": pa.array(out["befores"], pa.list_(pa.int64())),
            "crcs": pa.array(out["crcs"], pa.list_(pa.int64()))})


def _documents(batches):
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            symbols = rans.decode(row["blocks"], np.frombuffer(row["symbols"], dtype="<u4"),
                                  np.frombuffer(row["frequencies"], dtype="<u4"))
            cut = np.cumsum([0, *row["doc_tokens"]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(symbols.astype(np.int64)))],
                ["doc_id", "ids"])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file set: ``doc_id``, ``ids`` (array, end id included)."""
    ship(spark)
    return (spark.read.schema(_FILE).parquet(path).select("doc_ids", "doc_tokens", "symbols", "frequencies", "blocks")
            .mapInArrow(_documents, "doc_id bigint, ids array<bigint>"))


def token_file_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the decoded files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it: totals by partition (one row each) are
    added up first, then segments inside a partition, then documents inside a segment.
    """
    ship(spark)
    files = spark.read.schema(_FILE).parquet(path)
    sizes = files.select("part", "segment", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select(
        "part", "segment",
        (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("segment_start"))
    decoded = files.drop("n_tokens").mapInArrow(
        _decoded, "part int, segment int, doc_ids array<bigint>, doc_tokens array<bigint>, befores array<bigint>, "
                  "crcs array<bigint>")
    rows = decoded.join(starts, ["part", "segment"]).select(
        "segment_start", F.explode(F.arrays_zip("doc_ids", "befores", "doc_tokens", "crcs")).alias("d"))
    return rows.select(F.col("d.doc_ids").alias("doc_id"), (F.col("segment_start") + F.col("d.befores")).alias("start"),
                       F.col("d.doc_tokens").alias("n_tokens"), F.col("d.crcs").alias("ids_crc32"))


def token_output(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, **kw) -> DataFrame:
    """Write ``docs`` with :func:`write_token_files`, then read the files back with :func:`token_file_index`."""
    path = path or shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, **kw)
    return token_file_index(docs.sparkSession, path)
