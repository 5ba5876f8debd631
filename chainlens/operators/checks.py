"""Declared constraints (PK, FK, NOT NULL, ENUM, DEFAULT, DECIMAL) as data-quality
reports.  Spark enforces none of them on DataFrames, so each rule returns the
violating keys or per-column counts; every check is one distributed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.functions import constants as K


def check_pk(df: DataFrame, key, table: str) -> DataFrame:
    """Keys that are NULL or occur more than once: table, key, n.

    ``key`` may be several columns (a composite key, e.g. the integer parts of a
    text id): the shuffle then carries the narrow typed columns, and the text
    form ``a-b`` is built only for the violating keys.
    """
    cols = [key] if isinstance(key, str) else list(key)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_cl_n"))
    any_null = None
    for c in cols:
        any_null = F.col(c).isNull() if any_null is None else (any_null | F.col(c).isNull())
    text = (F.col(cols[0]).cast("string") if len(cols) == 1
            else F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))
    return g.where((F.col("_cl_n") > 1) | any_null).select(
        F.lit(table).alias("table_name"), text.alias("key"), F.col("_cl_n").cast("long").alias("n"))


def check_fk(child: DataFrame, fk: str, parent: DataFrame, pk: str, relation: str) -> DataFrame:
    """Child keys with no parent row (a NULL foreign key is allowed): relation, key, n.

    Child rows are counted per key first (map-side combined), so the anti join
    sees one row per distinct key — a hot key costs nothing extra.
    """
    per_key = (child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k"))
               .agg(F.count(F.lit(1)).cast("long").alias("n")))
    orphans = per_key.join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
    return orphans.select(F.lit(relation).alias("relation"), F.col("_k").cast("string").alias("key"), "n")


def check_not_null(df: DataFrame, columns, table: str) -> DataFrame:
    """NULL count per declared NOT NULL column: table, column_name, null_count."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "null_count").select(
        F.lit(table).alias("table_name"), "column_name", "null_count")


def check_enum(df: DataFrame, column: str, domain, table: str) -> DataFrame:
    """Values outside the declared domain (NULL allowed): table, column_name, value, n."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(domain)))
    return (bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).cast("long").alias("n"))
            .select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "value", "n"))


def apply_defaults(df: DataFrame, table: str, defaults: dict | None = None) -> DataFrame:
    """Add declared DEFAULT columns that are absent on ingest, in their declared types.

    Like a SQL DEFAULT, an explicit NULL in a present column is left alone.
    """
    defaults = K.COLUMN_DEFAULTS[table] if defaults is None else defaults
    types = K.DEFAULT_TYPES.get(table, {})
    present = set(df.columns)
    for name, value in defaults.items():
        if name not in present:
            df = df.withColumn(name, F.lit(value).cast(types[name]) if name in types else F.lit(value))
    return df


def with_load_timestamp(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Stamp rows with the load time (TIMESTAMP DEFAULT CURRENT_TIMESTAMP)."""
    return df.withColumn(column, F.current_timestamp())


def decimal_misfit(c: str, precision: int, scale: int) -> Column:
    """Whether DECIMAL(p,s) can't hold a value as it is: it has too many digits before the point (``try_cast``
    gives NULL) or after it (the cast differs from the value)."""
    cast = F.col(c).try_cast(f"decimal({precision},{scale})")
    exact = F.col(c).try_cast("decimal(38,18)")
    return F.col(c).isNotNull() & (cast.isNull() | (cast.cast("decimal(38,18)") != exact))


def decimal_conformity(df: DataFrame, spec: dict, table: str) -> DataFrame:
    """Per column: values that DECIMAL(p,s) can't hold as they are.

    Output: table, column_name, declared_type, non_conforming.
    """
    names = list(spec)
    counts = df.agg(*[F.count_if(decimal_misfit(c, p, s)).cast("long").alias(c) for c, (p, s) in spec.items()])
    types = F.create_map(*[x for c, (p, s) in spec.items() for x in (F.lit(c), F.lit(f"DECIMAL({p},{s})"))])
    return (counts.unpivot([], names, "column_name", "non_conforming")
            .select(F.lit(table).alias("table_name"), "column_name",
                    types[F.col("column_name")].alias("declared_type"), "non_conforming"))


def row_counts(tables: dict) -> DataFrame:
    """Row count per named table: table_name, rows (one aggregate per table, unioned)."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).cast("long").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


_V1_SOURCES = "spark.sql.sources.useV1SourceList"


def footer_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Row count per named Parquet folder: table_name, rows, from the files' footers alone.

    The count is pushed into the (version 2) Parquet source, which adds up the row groups' counts and reads no
    column; tables of bucketed or other formats are counted by :func:`row_counts`.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")  # read when the plan is made
    before = spark.conf.get(_V1_SOURCES)
    spark.conf.set(_V1_SOURCES, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        return row_counts({name: spark.read.parquet(path) for name, path in paths.items()})
    finally:
        spark.conf.set(_V1_SOURCES, before)
