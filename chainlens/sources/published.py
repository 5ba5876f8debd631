"""Published results: staged, verified, and switched in one step.

:func:`publish` writes a result beside the published one, reads it back and compares row count and content hash with
what was observed while writing, and only then names it the current one by creating one empty marker file.  A run that fails at any
point leaves the published result as it was; a run that is repeated under its id finds its marker and does nothing.

Layout below ``path``: ``runs/<run id>/`` holds data, ``_versions/<number>.<run id>`` the markers; the highest
number is current.  One writer at a time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from chainlens.sources import sinks

FORMATS = ("parquet", "csv", "json")


class VerificationError(RuntimeError):
    """What was read back is not what was written."""


def _content(df: DataFrame, fmt: str) -> list:
    """Aggregates that tell row sets apart whatever their order: the number of rows and the sum of row hashes.

    CSV has one text for NULL and the empty string; there they count as equal.
    """
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, MapType)]
    if maps:
        raise ValueError(f"map columns {maps} have no hash; publish them as arrays of entries")
    values = [F.nullif(F.col(f"`{f.name}`"), F.lit("")) if fmt == "csv" and isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
              for f in df.schema.fields]
    row = F.xxhash64(*values).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).alias("hash")]


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    fs, folder = _fs(spark, f"{path}/_versions")
    if not fs.exists(folder):
        return []
    found = [re.fullmatch(r"(\d+)\.(.+)", s.getPath().getName()) for s in fs.listStatus(folder)]
    return sorted((int(m[1]), m[2]) for m in found if m)


def _read(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path)
    reader = reader.options(**sinks.TIMES)
    return reader.json(path) if fmt == "json" else reader.option("header", True).csv(path)


def _write(df: DataFrame, path: str, fmt: str) -> None:
    {"parquet": sinks.write_parquet, "csv": sinks.write_csv, "json": sinks.write_json}[fmt](df, path)


def _stage(df: DataFrame, path: str, fmt: str) -> tuple[int, int]:
    """Write ``df`` to ``path`` and verify it: ``(rows, hash)``.  Its rows are computed once."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    seen = Observation(f"published-{uuid.uuid4().hex}")
    _write(df.observe(seen, *_content(df, fmt)), path, fmt)
    sent = seen.get
    back = _read(df.sparkSession, path, fmt, df.schema)
    got = back.agg(*_content(back, fmt)).first()
    if (got.rows, got.hash) != (sent["rows"], sent["hash"]):
        raise VerificationError(f"{path}: wrote {sent['rows']} rows, read {got.rows}"
                                + ("" if got.rows != sent["rows"] else " with other values"))
    return got.rows, int(got.hash)


def publish(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> str:
    """Make ``df`` the current result at ``path``; returns the folder of its data."""
    if not re.fullmatch(r"[\w-]+", run_id):
        raise ValueError("a run id has letters, digits, _ and -")
    spark, path = df.sparkSession, path.rstrip("/")
    target = f"{path}/runs/{run_id}"
    versions = _versions(spark, path)
    if run_id in (r for _, r in versions):
        return target
    _stage(df, target, fmt)
    number = versions[-1][0] + 1 if versions else 1
    fs, marker = _fs(spark, f"{path}/_versions/{number:010d}.{run_id}")
    fs.create(marker, False).close()
    return target


def current_path(spark: SparkSession, path: str) -> str:
    """Folder of the current result's data."""
    versions = _versions(spark, path.rstrip("/"))
    if not versions:
        raise FileNotFoundError(f"nothing published at {path}")
    return f"{path.rstrip('/')}/runs/{versions[-1][1]}"


def read_published(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    """The current result; text formats need its ``schema``."""
    where = current_path(spark, path)
    if fmt == "parquet" and schema is None:
        return spark.read.parquet(where)
    return _read(spark, where, fmt, schema)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str], staging: str, run_id: str) -> None:
    """Replace the partitions of ``path`` that ``df`` has rows for; the others stay as they are.

    The rows are staged and verified first, so a failure before the exchange changes nothing, and one during it is mended by
    running again under the same id: the staged rows are taken, not computed anew, and replacing a partition twice is the same as once.
    """
    spark = df.sparkSession
    publish(df, staging, run_id)
    rows = spark.read.schema(df.schema).parquet(f"{staging.rstrip('/')}/runs/{run_id}")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
