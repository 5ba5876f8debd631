"""Token counts through a digest cache.

A cache row is (content digest, tokenizer version, count).  The texts' digests are joined to the
stored rows of the tokenizer's version, only distinct texts without one are encoded, and their
counts are appended; the answer is then one join.  The cache is a Parquet table that later runs
(also on other tables) go on using.

The content is normalised only as far as the count can't change, which for any tokenizer means not
at all; NULL counts as the empty text.  Defined results: rows keep their ids, NULL and repeated
ids included; an empty table gives an empty result; other columns are ignored.  A cache that two
runs fill at once may hold a digest twice with the same count; it is read once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm import tokens
from chainlens.llm.common import shared_path, ship, text_or_empty, written

_CACHE_SCHEMA = "digest binary, n_tokens bigint, version string"


def _counter(tokenizer: str):
    def count(batches):
        enc = tokens.Encoder(tokenizer, counts=True)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), pa.array(enc.encode(texts), pa.int64())], ["digest", "n_tokens"])

    return count


def cached_token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id",
                        text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    ``tokenizer`` is the file of a ``tokenizers`` tokenizer (a path or a public name); ``cache`` the
    folder of the cache table (None: a new one in the shared folder, so all texts are misses).
    """
    spark = docs.sparkSession
    ship(spark)
    cache = cache or shared_path(spark, "token-cache")
    version = tokens.digest(tokenizer)
    spark.createDataFrame([], _CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(cache)

    def stored():
        return (spark.read.schema(_CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
                .select("digest", "n_tokens").dropDuplicates(["digest"]))

    text = text_or_empty(text_col)
    # never NULL by its type: the joins need no NULL filter, which would compute the hash again
    digest = F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))
    rows = docs.select(F.col(id_col), text.alias("text"), digest.alias("digest"))
    # Equal texts meet in the map tasks already: (digest, text) has no other columns to carry.
    misses = rows.select("digest", "text").distinct().join(stored().select("digest"), "digest", "left_anti")
    (misses.mapInArrow(_counter(tokenizer), "digest binary, n_tokens bigint")
     .withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache))
    ids = rows.select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    # written, so that the join alone deals the rows out and a hot digest can be split
    return ids.join(written(stored(), "counts"), "digest").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
