"""Bucketed fact tables: the lineitem-orders join runs without a shuffle and gives the same answer."""

import re

from chainlens.operators import revenue
from chainlens.sources import layout
from chainlens.sources import testdata as td

SF = "/root/testdata/sf0.001"


def test_bucketed_join_has_no_exchange(spark, tmpdir_fresh):
    layout.write_bucketed(spark, SF, "cl_bucketed", buckets=4, location=tmpdir_fresh)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        t = td.Tables(spark, SF, database="cl_bucketed")
        lines = td.orders_lines(t, status=None, dims=())
        plan = lines._jdf.queryExecution().executedPlan().toString()
        smj = plan[plan.index("SortMergeJoin"):]
        # both join inputs are bucket scans: no Exchange feeds the join
        assert "Exchange" not in smj, plan
        assert len(re.findall(r"SelectedBucketsCount: 4 out of 4", plan)) == 2
        a = {tuple(r) for r in revenue.monthly_revenue_mom(td.orders_lines(t, "Delivered", dims=())).collect()}
        b = {tuple(r) for r in revenue.monthly_revenue_mom(
            td.orders_lines(td.Tables(spark, SF), "Delivered", dims=())).collect()}
        assert a == b and len(a) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", prev)
