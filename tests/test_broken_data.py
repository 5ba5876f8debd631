"""All queries against their oracles on tables with missing dimension rows, unknown codes and orphans."""

import pytest
from pyspark.sql import functions as F

from chainlens.plans.catalog import QUERIES
from chainlens.plans.oracle import ORACLE
from tests.conftest import SF_SMALL
from tests.oracle_check import TABLES, compare


@pytest.fixture(scope="module")
def broken(spark, tmp_path_factory):
    """sf0.001 without every tenth customer, part, supplier and nation 3; some orders of status X and events of
    type odd; three lines of an unknown order and supplier."""
    out = str(tmp_path_factory.mktemp("broken"))
    read = lambda t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
    t = {name: read(name) for name in TABLES}
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")):
        t[name] = t[name].where(F.col(key) % 10 != 0)
    t["nation"] = t["nation"].where("n_nationkey <> 3")
    t["orders"] = t["orders"].withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 1, "X").otherwise(
        F.col("o_orderstatus")))
    t["events"] = t["events"].withColumn("event_type", F.when(F.col("event_id") % 40 == 1, "odd").otherwise(
        F.col("event_type")))
    li = t["lineitem"]
    orphans = li.orderBy("l_orderkey", "l_linenumber").limit(3).withColumn(
        "l_orderkey", F.lit(10**9).cast(li.schema["l_orderkey"].dataType)).withColumn(
        "l_suppkey", F.lit(999999).cast(li.schema["l_suppkey"].dataType))
    t["lineitem"] = li.unionByName(orphans)
    for name, df in t.items():
        df.coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


def _duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, broken, name):
    r = compare(spark, _duck(broken), name, QUERIES[name], ORACLE[name], broken)
    assert r["ok"] is True, r


def test_violations_are_found(spark, broken):
    fk = {(r.relation, r.key): r.n for r in QUERIES["check_fk"](spark, broken).collect()}
    assert fk["orders.supplier_id->suppliers", "999999"] == 3
    assert fk["quality_inspections.order_id->orders", str(10**9)] == 3
    enum = {(r.table_name, r.value): r.n for r in QUERIES["check_enum"](spark, broken).collect()}
    assert enum["orders", "X"] > 0 and enum["machine_events", "odd"] > 0
    counts = {r.table_name: r.rows for r in QUERIES["table_row_counts"](spark, broken).collect()}
    assert counts["orders"] == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count() + 3


def test_no_revenue_is_lost_with_missing_customers(spark, broken):
    by_customer = sum(r.total_revenue for r in QUERIES["revenue_by_customer"](spark, broken).collect())
    by_month = sum(r.revenue for r in QUERIES["monthly_revenue_mom"](spark, broken).collect())
    assert by_customer == pytest.approx(by_month)
