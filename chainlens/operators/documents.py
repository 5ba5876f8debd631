"""Semi-structured documents as VARIANT: one parse per document, typed reads by path, unknown keys kept.

A document arrives as JSON text and is parsed once into a VARIANT column.  A declared schema is then read
from it path by path (``try_variant_get``: an absent key, a NULL object or a value of another type
reads as NULL), which gives the struct columns that the document operators already flatten, so
:func:`~chainlens.operators.events.flatten_events` and
:func:`~chainlens.operators.feedback.flatten_feedback` serve both forms.  Keys outside the declared
schema stay in the VARIANT: :func:`unknown_keys` lists them, and a later schema can read them without loading again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENT = "document"


def parse_documents(texts: DataFrame, text: str = "text", lenient: bool = False) -> DataFrame:
    """``document`` (VARIANT) in place of the JSON text column; other columns are kept.

    Malformed JSON is an error; ``lenient`` keeps such a row with a NULL document instead.
    """
    parse = F.try_parse_json if lenient else F.parse_json
    return texts.withColumn(DOCUMENT, parse(F.col(text))).drop(*([] if text == DOCUMENT else [text]))


def _step(name: str) -> str:
    if re.fullmatch(r"[A-Za-z_]\w*", name):
        return f".{name}"
    if '"' not in name:
        return f'["{name}"]'
    raise ValueError(f"a key with a quote cannot be a path step: {name!r}")


def _read(path: str, kind) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*[_read(path + _step(f.name), f.dataType).alias(f.name) for f in kind.fields])
    return F.try_variant_get(DOCUMENT, path, kind.simpleString())


def structured(docs: DataFrame, schema: StructType, keep: bool = False) -> DataFrame:
    """The columns of ``schema`` read from the documents; ``keep`` adds the whole VARIANT."""
    cols = [_read("$" + _step(f.name), f.dataType).alias(f.name) for f in schema.fields]
    return docs.select(*cols, *([DOCUMENT] if keep else []))


def _objects(schema: StructType, path: str = "$"):
    """``(path, declared keys)`` of every declared object, the document itself first."""
    yield path, [f.name for f in schema.fields]
    for f in schema.fields:
        if isinstance(f.dataType, StructType):
            yield from _objects(f.dataType, path + _step(f.name))


def unknown_keys(docs: DataFrame, schema: StructType, id_path: str) -> DataFrame:
    """One row per document and key that ``schema`` doesn't declare, at any declared level:
    ``id`` (text), ``path``, ``kind`` (SQL type of the value), ``value`` (JSON text).

    Objects are taken apart in the task that reads the document (a generator over its keys); nothing is shuffled.
    """
    objects = [F.struct(F.lit(path).alias("path"), F.array(*[F.lit(k) for k in keys]).alias("known"),
                        (F.col(DOCUMENT) if path == "$" else F.try_variant_get(DOCUMENT, path, "variant")).alias("object"))
               for path, keys in _objects(schema)]
    spark = docs.sparkSession
    parts = docs.select(F.try_variant_get(DOCUMENT, id_path, "string").alias("id"), F.explode(F.array(*objects)).alias("o"))
    # a value that is no object has no keys
    parts = parts.where(F.schema_of_variant("o.object").startswith("OBJECT")).select("id", "o.*")
    keys = parts.lateralJoin(spark.tvf.variant_explode(F.col("object").outer()))
    return (keys.where(~F.array_contains("known", F.col("key")))
            .select("id", F.concat("path", F.lit("."), "key").alias("path"), F.schema_of_variant("value").alias("kind"),
                    F.to_json("value").alias("value")))


def unknown_key_summary(unknown: DataFrame) -> DataFrame:
    """path, kind, documents: how many documents carry each key that the schema doesn't declare."""
    return (unknown.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("documents"))
            .orderBy("path", "kind"))
