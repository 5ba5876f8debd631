"""Property tests: the distributed prefix sum and exact quantiles against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlens.functions.windows import exact_quantiles, running_sum

SETTINGS = dict(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(**SETTINGS)
@given(values=st.lists(st.integers(-1000, 1000), min_size=1, max_size=300),
       in_parts=st.integers(1, 7))
def test_running_sum_equals_serial_cumsum(spark, values, in_parts):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(in_parts)
    got = dict(running_sum(df, "v", "v", "run", descending=True, ties=["k"]).select("k", "run").collect())
    expect, acc = {}, 0
    for k, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        acc += v
        expect[k] = acc
    assert got == expect


@settings(**SETTINGS)
@given(values=st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 40)), min_size=1, max_size=300),
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_grouped_quantiles_equal_numpy(spark, values, probs):
    df = spark.createDataFrame(values, "g string, x long")
    names = [f"q{i}" for i in range(len(probs))]
    got = {r.g: r for r in exact_quantiles(df, "x", probs, names, by=["g"], mean_name="m").collect()}
    for g in {v[0] for v in values}:
        xs = np.array([x for gg, x in values if gg == g], dtype=float)
        for n, p in zip(names, probs):
            assert got[g][n] == pytest.approx(np.quantile(xs, p), rel=1e-9, abs=1e-9)
        assert got[g].m == pytest.approx(xs.mean())


def test_quantiles_ignore_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (3,), (1,)], "x long")
    r = exact_quantiles(df, "x", [0.5], ["med"]).first()
    assert r.med == 2.0
    empty = spark.createDataFrame([], "x long")
    assert exact_quantiles(empty, "x", [0.5], ["med"]).first().med is None


def test_running_sum_with_coalesced_partitions(spark):
    import random

    rng = random.Random(11)
    rows = [(i, rng.randint(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = dict(running_sum(df, "v", "v", "run", ties=["k"]).select("k", "run").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    expect, acc = {}, 0
    for k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        acc += v
        expect[k] = acc
    assert got == expect


@settings(**SETTINGS)
@given(heads=st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 12)), st.sampled_from(["A", "B", None]),
                                st.sampled_from(["P1", "P2"]), st.integers(0, 500)), min_size=1, max_size=40),
       insp=st.lists(st.tuples(st.integers(1, 14), st.integers(0, 80), st.sampled_from([0, 1])), max_size=40),
       dedupe=st.booleans())
def test_plant_efficiency_equals_literal_join(spark, heads, insp, dedupe):
    """Single-pass rewrite == LEFT JOIN + COUNT(DISTINCT) x2 written literally (random data with
    duplicate order ids, NULL ids/customers, orders with 0..n inspections)."""
    from decimal import Decimal

    from chainlens.operators import plant

    h = spark.createDataFrame([(o, c, p, Decimal(r), "Delivered") for o, c, p, r in heads],
                              "order_id long, customer string, plant string, revenue decimal(14,2), status string")
    i = spark.createDataFrame([(o, Decimal(dr) / 1000, ps) for o, dr, ps in insp],
                              "order_id long, defect_rate decimal(6,4), passed int")
    got = {r.plant: r for r in plant.plant_efficiency(h, i, dedupe_orders=dedupe).collect()}
    j = h.join(i, "order_id", "left")
    if dedupe:
        j = h.join(i.groupBy("order_id").agg(F.sum("defect_rate").alias("s"), F.count("defect_rate").alias("c"),
                                             F.sum(F.when(F.col("passed") == 0, 1).otherwise(0)).alias("f")),
                   "order_id", "left")
        want = j.groupBy("plant").agg(F.countDistinct("order_id").alias("o"), F.sum("revenue").alias("rev"),
                                      F.avg("revenue").alias("aov"), F.countDistinct("customer").alias("u"),
                                      (F.sum("s") * 100 / F.sum("c")).alias("adr"), F.coalesce(F.sum("f"), F.lit(0)).alias("fb"))
    else:
        want = j.groupBy("plant").agg(F.countDistinct("order_id").alias("o"), F.sum("revenue").alias("rev"),
                                      F.avg("revenue").alias("aov"), F.countDistinct("customer").alias("u"),
                                      (F.avg("defect_rate") * 100).alias("adr"),
                                      F.sum(F.when(F.col("passed") == 0, 1).otherwise(0)).alias("fb"))
    want = {r.plant: r for r in want.collect()}
    assert set(got) == set(want)
    for p, w in want.items():
        g = got[p]
        assert g.total_orders == w.o and g.unique_customers == w.u and g.failed_batches == w.fb
        assert g.total_revenue == pytest.approx(float(w.rev))
        assert g.avg_order_value == pytest.approx(float(round(w.aov, 2)), abs=0.006)
        if w.adr is None:
            assert g.avg_defect_rate_pct is None
        else:
            assert g.avg_defect_rate_pct == pytest.approx(float(w.adr), abs=0.0006)


def test_weighted_quantiles_equal_expanded(spark):
    rows = [("a", 1, 3), ("a", 5, 1), ("b", 2, 2), ("b", 9, 2)]
    df = spark.createDataFrame(rows, "g string, x long, w long")
    got = {r.g: (r.med, r.m) for r in exact_quantiles(df, "x", [0.5], ["med"], by=["g"], weight="w",
                                                       mean_name="m").collect()}
    assert got == {"a": (1.0, 2.0), "b": (5.5, 5.5)}


def test_grouped_quantiles_keep_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 5)], "g string, x long")
    got = {r.g: r.med for r in exact_quantiles(df, "x", [0.5], ["med"], by=["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def _serial(rows, key, descending):
    expect, acc = {}, None
    nulls = sorted((r for r in rows if r[1] is None), key=key)
    some = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1] if descending else r[1], key(r)))
    for r in some + nulls:
        if r[1] is not None:
            acc = r[1] + (acc or 0)
        expect[r[0]] = acc
    return expect


@settings(**SETTINGS)
@given(values=st.lists(st.sampled_from([0, 0, 0, 5, 5, 6, -3, None, None, 1000]), min_size=1, max_size=200),
       descending=st.booleans(), hot=st.integers(1, 40), text=st.booleans())
def test_running_sum_with_hot_values(spark, values, descending, hot, text):
    """Values that many rows hold are cut into slices by their ties; the sums stay those of one sorted pass."""
    name = lambda i: f"customer-{i * 7919 % 1009}" if text else i * 7919 % 1009
    rows = [(name(i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"k {'string' if text else 'long'}, v long").repartition(3)
    got = dict(running_sum(df, "v", "v", "run", descending=descending, ties=["k"], hot_rows=hot).select("k", "run").collect())
    assert got == _serial(rows, lambda r: r[0], descending)


@pytest.mark.parametrize("text", [False, True])
def test_hot_values_bound_a_window_partition(spark, text):
    """A third of the rows zero, a third NULL: no window partition holds more than a few times ``hot_rows``."""
    from chainlens.functions import windows as w

    key = F.format_string("C%09d", "id") if text else F.col("id")
    df = spark.range(9000).select(key.alias("k"), F.when(F.col("id") % 3 == 0, 0.0).when(
        F.col("id") % 3 == 1, F.col("id") / 7).alias("v"))
    rows = w._sliced(df.withColumn(w._BUCKET, w.sort_bucket("v")), w.whole_row(df), F.col("v"), False, "k", [], 100)
    most = rows.groupBy(w._BUCKET, w._PLACE, w._SLICE).count().agg(F.max("count")).first()[0]
    assert most <= 1200 if text else most <= 200
