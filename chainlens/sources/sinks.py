"""Writers.  Every sink is a distributed write; nothing goes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, MapType, StructType


# Text formats keep microseconds (Spark's default writes milliseconds).
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _assert_flat(df: DataFrame) -> None:
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    if nested:
        raise ValueError(f"CSV cannot hold nested columns {nested}; flatten them first")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headed CSV without an index column, one file per task."""
    _assert_flat(df)
    df.write.mode(mode).options(**TIMES).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines (splittable) — nested documents keep their structure."""
    df.write.mode(mode).options(**TIMES).json(path)


def preview(df: DataFrame, rows: int | None = None, out=None) -> int:
    """Print ``rows`` rows as tab-separated text, or with None the whole result; returns their number.

    A head is a limit in the plan; the whole result comes partition by partition, so the driver holds one at a time.
    """
    shown = 0
    print("\t".join(df.columns), file=out)
    for row in (df if rows is None else df.limit(rows)).toLocalIterator():
        print("\t".join("NULL" if v is None else str(v) for v in row), file=out)
        shown += 1
    return shown
