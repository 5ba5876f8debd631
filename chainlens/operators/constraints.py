"""Many constraints in one pass over a table.

:mod:`~chainlens.operators.checks` answers one question per pass (which keys, which values).  Here all rules of a table are
counted together: :func:`constraint_report` groups the rows by the primary key once, carrying each row rule as a sum, so that
one scan and one combined shuffle give every count; and :func:`observed` counts the row rules while the table is being written
anyway, with no pass of their own.  The counts equal those of the separate checks.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chainlens.functions.numeric import as_long
from chainlens.operators.checks import decimal_misfit
from chainlens.operators.distinct import BITMAP, BUCKET, key_bitmaps


@dataclass(frozen=True)
class Rules:
    """The declared constraints of a table; references name a parent frame and its key."""

    table: str
    primary_key: Sequence[str] = ()
    references: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)
    not_null: Sequence[str] = ()
    enums: Mapping[str, Sequence] = field(default_factory=dict)
    decimals: Mapping[str, tuple[int, int]] = field(default_factory=dict)


def _row_rules(rules: Rules) -> dict[tuple[str, str], Column]:
    """``(rule, column) -> whether a row breaks it``, for the rules that a row alone decides."""
    out = {("not_null", c): F.col(c).isNull() for c in rules.not_null}
    out |= {("enum", c): F.col(c).isNotNull() & ~F.col(c).isin(list(domain)) for c, domain in rules.enums.items()}
    return out | {("decimal", c): decimal_misfit(c, p, s) for c, (p, s) in rules.decimals.items()}


def _with_orphans(df: DataFrame, rules: Rules) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """``df`` with a flag per reference: the key is there and its parent is not."""
    flags = {}
    for i, (fk, (parent, pk)) in enumerate(rules.references.items()):
        key, flag = f"_p{i}", f"_orphan{i}"
        keys = parent.select(F.col(pk).alias(key)).where(F.col(key).isNotNull()).distinct()
        df = df.join(keys, F.col(fk) == F.col(key), "left").withColumn(
            flag, F.col(fk).isNotNull() & F.col(key).isNull()).drop(key)
        flags["reference", fk] = F.col(flag)
    return df, flags


def constraint_report(df: DataFrame, rules: Rules) -> DataFrame:
    """table_name, rule, column_name, violations: one row per declared constraint, also those that hold.

    Counted are rows, for ``primary_key`` keys that are NULL in part or occur more than once.
    """
    rows, flags = _with_orphans(df, rules)
    flags |= _row_rules(rules)
    names = {f"v{i}": rule for i, rule in enumerate(flags)}
    counts = [F.count_if(flags[rule]).alias(n) for n, rule in names.items()]
    if rules.primary_key:
        key = list(rules.primary_key)
        any_null = F.lit(False)
        for c in key:
            any_null = any_null | F.col(c).isNull()
        per_key = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *counts)  # combined in the task first
        totals = per_key.agg(F.count_if((F.col("_n") > 1) | any_null).alias("pk"),
                             *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        names = {"pk": ("primary_key", "-".join(key)), **names}
    else:
        totals = rows.agg(*counts)
    label = F.create_map(*[x for n, (rule, c) in names.items() for x in (F.lit(n), F.struct(
        F.lit(rule).alias("rule"), F.lit(c).alias("column_name")))])
    long = totals.select(*[as_long(n).alias(n) for n in names]).unpivot([], list(names), "name", "violations")
    return long.select(F.lit(rules.table).alias("table_name"), label[F.col("name")]["rule"].alias("rule"),
                       label[F.col("name")]["column_name"].alias("column_name"), "violations")


def observed(df: DataFrame, rules: Rules) -> tuple[DataFrame, Observation]:
    """``(rows, observation)``: write the rows as they are; ``observation.get`` then has ``rows`` and the number of
    rows that break each rule, by ``rule:column`` (all but the primary key, which one row can't break alone)."""
    rows, flags = _with_orphans(df, rules)
    flags |= _row_rules(rules)
    seen = Observation(f"{rules.table}-{uuid.uuid4().hex}")
    out = rows.observe(seen, F.count(F.lit(1)).alias("rows"),
                       *[F.count_if(flag).alias(f"{rule}:{c}") for (rule, c), flag in flags.items()])
    return out.select(*df.columns), seen


def check_reference_by_bitmaps(child: DataFrame, fk: str, parent: DataFrame, pk: str, relation: str) -> DataFrame:
    """Child keys without a parent row, for integer keys of any number: relation, key, n.

    Both tables' keys become bitmaps in the tasks that read them, so what is shuffled first is 4 KB per 32,768 keys.  A bucket whose
    child bits are all among its parent bits holds no orphan; only the keys of the other buckets (candidates) are
    shuffled as rows, to name and count the orphans exactly.  The candidates' numbers (one for each 32,768 keys of a
    range with orphans) are broadcast, as rows joined by their bucket would all meet in one task: a few
    thousand suppliers are one bucket, whatever the number of lines.  A Bloom filter in place of the bitmaps would be
    no exact test here: its false positives are orphans that look like children with a parent.
    """
    for df, c in ((child, fk), (parent, pk)):
        if not isinstance(df.schema[c].dataType, IntegralType):
            raise TypeError(f"{c} must be an integer column; use checks.check_fk for others")
    have = key_bitmaps(parent, [], pk).withColumnRenamed(BITMAP, "_have")
    want = key_bitmaps(child, [], fk).join(have, BUCKET, "left")
    # bits that the child adds to the parent's
    both = want.select(BUCKET, F.explode(F.array("_have", BITMAP)).alias("b"), "_have").where(F.col("b").isNotNull())
    added = both.groupBy(BUCKET).agg(F.bitmap_count(F.bitmap_or_agg("b")).alias("_all"),
                                     F.max(F.coalesce(F.bitmap_count("_have"), F.lit(0))).alias("_have"))
    suspect = F.broadcast(added.where(F.col("_all") > F.col("_have")).select(F.col(BUCKET).alias("_b")))
    bucket = lambda c: F.bitmap_bucket_number(F.col(c).cast("long"))
    keys = (child.select(F.col(fk).alias("_k")).where(F.col("_k").isNotNull()).join(suspect, bucket("_k") == F.col("_b"), "left_semi")
            .groupBy("_k").agg(F.count(F.lit(1)).cast("long").alias("n")))
    parents = parent.select(F.col(pk).alias("_k")).join(suspect, bucket("_k") == F.col("_b"), "left_semi")
    orphans = keys.join(parents, "_k", "left_anti")
    return orphans.select(F.lit(relation).alias("relation"), F.col("_k").cast("string").alias("key"), "n")
