"""All constraints in one pass: equal to the separate checks, one scan, also while a table is written; SQL rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chainlens.functions import classify, sqlrules
from chainlens.operators import checks, constraints
from chainlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def broken(spark):
    rng = random.Random(2)
    rows = [(i % 90 if i % 7 else None, rng.choice([1, 2]), rng.choice([None, *range(12)]), rng.choice(["A", "B", None, "?"]),
             rng.choice(["1.25", "1.255", "x", None, "12345"])) for i in range(300)]
    rows += [(5, 1, 99, "A", "1")] * 150  # a third of the rows repeat one key with an unknown parent
    child = spark.createDataFrame(rows, "k long, n int, p long, e string, d string")
    parent = spark.createDataFrame([(i,) for i in (*range(10), 10, 10, None)], "id long")
    return child, constraints.Rules("t", ("k", "n"), {"p": (parent, "id")}, ("k", "d"), {"e": ("A", "B")}, {"d": (4, 2)}), parent


def separate(child, rules, parent):
    want = {("primary_key", "k-n"): checks.check_pk(child, ["k", "n"], "t").count(),
            ("reference", "p"): sum(r.n for r in checks.check_fk(child, "p", parent, "id", "r").collect())}
    want |= {("not_null", r.column_name): r.null_count for r in checks.check_not_null(child, ["k", "d"], "t").collect()}
    want["enum", "e"] = sum(r.n for r in checks.check_enum(child, "e", ("A", "B"), "t").collect())
    want["decimal", "d"] = checks.decimal_conformity(child, {"d": (4, 2)}, "t").first().non_conforming
    return want


def test_report_equals_the_separate_checks(spark, broken):
    got = {(r.rule, r.column_name): r.violations for r in constraints.constraint_report(*broken[:2]).collect()}
    assert got == separate(*broken) and all(got.values())
    empty = constraints.constraint_report(broken[0].limit(0), broken[1]).collect()
    assert len(empty) == len(got) and not any(r.violations for r in empty)


def test_one_scan(spark):
    df = QUERIES["constraint_report"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    for t in ("lineitem", "orders", "supplier"):
        assert len(re.findall(rf"FileScan parquet.*/{t}\.parquet", final)) == 1


def test_observed_while_written(spark, broken, tmp_path):
    child, rules, parent = broken
    out, seen = constraints.observed(child, rules)
    out.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.columns == child.columns and back.exceptAll(child).count() == 0 and back.count() == child.count()
    got = seen.get
    assert got.pop("rows") == child.count()
    assert got == {f"{r}:{c}": n for (r, c), n in separate(*broken).items() if r != "primary_key"}


def test_references_by_bitmaps(spark, broken):
    child, _, parent = broken
    big = child.select((F.col("p") * 100_003).alias("p")), parent.select((F.col("id") * 100_003).alias("id"))
    for c, p in ((child, parent), big):
        a = {tuple(r) for r in checks.check_fk(c, "p", p, "id", "r").collect()}
        assert a and a == {tuple(r) for r in constraints.check_reference_by_bitmaps(c, "p", p, "id", "r").collect()}
    assert constraints.check_reference_by_bitmaps(child, "p", parent.limit(0), "id", "r").count() == child.select("p").distinct().count() - 1
    with pytest.raises(TypeError):
        constraints.check_reference_by_bitmaps(child, "e", parent, "id", "r")


def test_clean_buckets_send_no_rows(spark):
    """Only keys of buckets with an orphan reach the exact anti join."""
    child = spark.range(200_000).select(F.col("id").alias("p"))
    parent = spark.range(200_000).where("id <> 70000").select("id")
    df = constraints.check_reference_by_bitmaps(child, "p", parent, "id", "r")
    assert [(r.key, r.n) for r in df.collect()] == [("70000", 1)]
    plan = df._jdf.queryExecution().executedPlan()
    assert "LeftSemi" in plan.toString() and "bitmap_construct_agg" in plan.toString()


def test_rows_are_not_shuffled_by_bucket(spark):
    """All children of one bucket of parents would meet in one task, whose memory would grow with the table."""
    child = spark.range(20_000).select((F.col("id") % 50).alias("p"))
    parent = spark.range(50).where("id <> 7").select("id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = constraints.check_reference_by_bitmaps(child, "p", parent, "id", "r")
        assert [(r.key, r.n) for r in df.collect()] == [("7", 400)]
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        semi = [line for line in plan.splitlines() if "LeftSemi" in line]
        assert len(semi) == 2 and all("BroadcastHashJoin" in line for line in semi)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_footer_counts(spark):
    df = QUERIES["table_row_counts_footer"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == 5 and "FileScan" not in plan
    a = {tuple(r) for r in df.collect()}
    assert a == {tuple(r) for r in QUERIES["table_row_counts"](spark, SF).collect()}
    # the session's other readers stay as they were
    assert "FileScan parquet" in spark.read.parquet(f"{SF}/region.parquet")._jdf.queryExecution().executedPlan().toString()


def test_sql_rules_equal_the_classifiers(spark):
    names = sqlrules.register_rules(spark)
    assert "cl_supplier_rag" in names and len(names) == len(set(names))
    rng = random.Random(4)
    rows = [(rng.choice([None, 4.5, 3.8, 4.49, 3.79, 5.0]), rng.choice([None, 0.95, 0.85, 0.849, 1.0]),
             rng.choice([None, 0.0, 0.999, 1.0, 2.9999, 3.0]), rng.choice([None, 0.85, 0.7, 0.69999, 1.0])) for _ in range(200)]
    df = spark.createDataFrame(rows, "q double, o double, d double, e double").select(
        "*", classify.supplier_rag("q", "o").alias("a"), classify.below_rag("d").alias("b"),
        classify.at_least_rag("e", 0.85, 0.70).alias("c"))
    df.createOrReplaceTempView("cl_rule_rows")
    bad = spark.sql("SELECT * FROM cl_rule_rows WHERE a <> cl_supplier_rag(q, o) OR b <> cl_quality_rag(d) OR c <> cl_oee_rag(e)")
    assert bad.count() == 0
    assert spark.sql("SELECT cl_half_up(2.345, 2), cl_half_up(-2.345, 2), cl_half_up(NULL, 1)").first()[:] == (2.35, -2.35, None)


def test_sql_scorecard_equals_the_dataframe(spark):
    a, b = (QUERIES[n](spark, SF) for n in ("supplier_scorecard", "supplier_scorecard_sql"))
    assert a.columns == b.columns and a.collect() == b.collect()
    assert "PythonUDF" not in b._jdf.queryExecution().executedPlan().toString()
