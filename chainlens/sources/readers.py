"""Typed readers and SQL registration.

CSV and JSON are read with the declared schema (no inference pass over the
data).  Documents are JSON Lines by default, which tasks split; a file that is
one JSON array must be read by one task, so it is an option, and
:func:`array_to_lines` converts such files once.  Lines, arrays and Parquet give
the same DataFrame here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chainlens.operators.documents import DOCUMENT, parse_documents
from chainlens.sources import schemas

_BAD = "_bad_record"


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read a headed CSV with the declared schema of ``table``.

    Only the empty field is NULL: the literal text ``None`` is a real value
    (a defect type), not a missing one.  The header is checked against the
    declared column names (``enforceSchema=false``), so a file with reordered
    columns fails instead of loading shifted values.
    """
    return (spark.read.schema(schemas.BY_NAME[table])
            .option("header", True).option("enforceSchema", False)
            .option("nullValue", "").option("mode", "FAILFAST")
            .option("dateFormat", "yyyy-MM-dd")
            .csv(path))


def read_csv_with_rejects(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: the rows that fit the declared schema, and the text (``line``) of every line that doesn't.

    Lines are parsed one by one, so a quoted value has no line break; every file begins with the declared header, and a
    file with another one has that line among the rejects.  Both results read the file; write the rejects first if they are wanted beside
    the rows.
    """
    declared = schemas.BY_NAME[table]
    # a bad value must not hide behind a column that the schema calls NOT NULL
    schema = StructType([StructField(f.name, f.dataType) for f in declared.fields] + [StructField(_BAD, StringType())])
    lines = spark.read.text(path).where((F.col("value") != ",".join(declared.names)) & (F.trim("value") != ""))
    parsed = lines.select("value", F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "nullValue": "", "dateFormat": "yyyy-MM-dd"}).alias("row"))
    bad = F.col(f"row.{_BAD}").isNotNull()
    return (parsed.where(~bad).select(*[F.col(f"row.{n}").alias(n) for n in declared.names]),
            parsed.where(bad).select(F.col("value").alias("line")))


def read_documents(spark: SparkSession, path: str, collection: str, multi_line: bool = False) -> DataFrame:
    """Read nested JSON documents: JSON Lines, or with ``multi_line`` one array per file (one task each).

    Missing keys and ``{}`` objects read as NULL fields of the declared struct;
    malformed JSON is an error, never an empty document.
    """
    return (spark.read.schema(schemas.BY_NAME[collection])
            .option("multiLine", multi_line).option("mode", "FAILFAST")
            .json(path))


def read_variants(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """JSON Lines as a ``document`` VARIANT column each, whatever their keys; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_documents(lines, "value", lenient).select(DOCUMENT)


def array_to_lines(spark: SparkSession, path: str, out: str) -> None:
    """Convert files of one JSON array each to JSON Lines, keeping every key; one task per file, once."""
    arrays = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("a"))
    items = arrays.select(F.explode(F.variant_get("a", "$", "array<variant>")).alias(DOCUMENT))
    items.select(F.to_json(DOCUMENT).alias("value")).write.mode("errorifexists").text(out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """Expose ``df`` to SQL under ``name``, replacing any view of that name."""
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, text: str, args=None) -> DataFrame:
    """``text`` over the registered views; ``args`` are the values of its named (dict) or positional (list) markers."""
    return spark.sql(text, args=args)
