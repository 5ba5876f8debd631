"""Quantile sketches, distinct bitmaps and the incremental state: merged parts equal a recount of the rows."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlens.operators import distinct, incremental, revenue, rolling, sketches
from chainlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PROBS, NAMES = (0.0, 0.1, 0.5, 0.9, 1.0), ("lo", "p10", "med", "p90", "hi")


def test_sketch_ranks_after_two_merges(spark):
    """Days to months to a year: every quantile's true rank is within the sketch's error, extremes are exact."""
    rows = spark.range(60000).select((F.col("id") % 365).alias("day"), (F.hash("id") % 1000 * 1.5 + F.hash("id") % 7).alias("v"))
    daily = sketches.value_sketches(rows, ["day"], "v")
    monthly = sketches.roll_up(daily, [(F.col("day") / 31).cast("int").alias("month")])
    yearly = sketches.roll_up(monthly, [F.lit(1).alias("year")])
    for level, by, facts in ((monthly, "month", rows.withColumn("month", (F.col("day") / 31).cast("int"))),
                             (yearly, "year", rows.withColumn("year", F.lit(1)))):
        q = sketches.sketch_quantiles(level, PROBS, NAMES)
        off = sketches.rank_errors(facts, q, [by], "v", PROBS, NAMES).collect()
        assert len(off) == q.count() and all(r[n] <= 0.01 for r in off for n in NAMES)
        exact = {r[0]: (r.n, r.lo, r.hi) for r in facts.groupBy(by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        assert {r[by]: (r.n, r.lo, r.hi) for r in q.collect()} == exact


def test_roll_up_reads_no_facts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, 5.0), ("c", None)], "g string, v double")
    sketches.value_sketches(rows, ["g"], "v").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    whole = sketches.sketch_quantiles(sketches.roll_up(stored, [F.lit(0).alias("all")]), PROBS, NAMES)
    r = whole.first()
    assert (r.n, r.total, r.lo, r.med, r.hi) == (3, 9.0, 1.0, 3.0, 5.0)
    got = {r.g: (r.n, r.med) for r in sketches.sketch_quantiles(stored, PROBS, NAMES).collect()}
    assert got == {"a": (1, 1.0), "b": (1, 3.0), None: (1, 5.0), "c": (0, None)}
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "sketch" in plan and "v#" not in plan


@settings(**SETTINGS)
@given(rows=st.lists(st.tuples(st.integers(0, 30), st.one_of(st.none(), st.integers(0, 200000))), max_size=80))
def test_merged_bitmaps_equal_a_recount(spark, rows):
    df = spark.createDataFrame(rows, "day int, key long").withColumn("date", F.date_add(F.lit(dt.date(2023, 12, 10)), F.col("day")))
    got = {r.period: r.n for r in distinct.calendar_distinct(df, "date", "key", "n").collect()}
    want = {}
    for d, k in rows:
        date = dt.date(2023, 12, 10) + dt.timedelta(days=d)
        for p in (date.strftime("%Y-%m"), date.strftime("%Y"), "all"):
            if k is not None:
                want.setdefault(p, set()).add(k)
    assert got == {p: len(s) for p, s in want.items()}


def test_several_counts_in_one_pass(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, *range(9)]), rng.randrange(10 ** 6)) for _ in range(500)] + [("z", None, 5)]
    df = spark.createDataFrame(rows, "g string, a int, b long")
    got = {r.g: (r.n_a, r.n_b) for r in distinct.distinct_columns(df, ["g"], {"n_a": "a", "n_b": "b"}).collect()}
    want = df.groupBy("g").agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")).collect()
    assert got == {r.g: (r.a, r.b) for r in want} and got["z"] == (0, 1)
    with pytest.raises(TypeError):
        distinct.key_bitmaps(df, [], "g")


@pytest.mark.parametrize("name", ["distinct_customers_calendar", "distinct_parties_by_month"])
def test_distinct_counts_expand_nothing(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    # what is shuffled by bucket are bitmaps made in the task
    assert "partial_bitmap_construct_agg" in plan


# --- incremental state ---------------------------------------------------------------------------

LINE = "order_id long, order_date date, delivery_date date, revenue decimal(14,2), status string"
line = st.tuples(st.integers(0, 9), st.one_of(st.none(), st.integers(0, 90)), st.one_of(st.none(), st.integers(0, 30)),
                 st.one_of(st.none(), st.integers(-500, 500)), st.sampled_from(["Delivered", "Delivered", "Pending"]))


def frame(spark, rows):
    from decimal import Decimal

    day = lambda n: None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)
    return spark.createDataFrame([(o, day(d), None if d is None or x is None else day(d + x), None if r is None else Decimal(r), s)
                                  for o, d, x, r, s in rows], LINE)


def values(state):
    return sorted(map(str, incremental.days(state).select("order_date", *incremental.SUMS).collect()))


@settings(**SETTINGS)
@given(first=st.lists(line, max_size=25), more=st.lists(line, max_size=15), data=st.data())
def test_changes_equal_a_recompute(spark, first, more, data):
    gone = data.draw(st.lists(st.sampled_from(range(len(first))), unique=True) if first else st.just([]))
    left = [r for i, r in enumerate(first) if i not in gone] + more
    state = incremental.merge(
        incremental.daily_changes(frame(spark, first)),
        incremental.daily_changes(incremental.signed(frame(spark, [first[i] for i in gone]), -1)),
        incremental.daily_changes(incremental.signed(frame(spark, more), 1)))
    assert values(state) == values(incremental.daily_changes(frame(spark, left)))


def test_stored_state(spark, tmp_path):
    rng = random.Random(7)
    make = lambda n: [(i, rng.choice([None, *range(90)]), rng.randrange(30), rng.randrange(900), "Delivered") for i in range(n)]
    first, more = make(80), [(1, 45, 3, 100, "Delivered"), (2, 46, None, 50, "Delivered")]
    gone = [r for r in first if r[1] is not None and 31 <= r[1] < 40]
    path = str(tmp_path / "state")
    incremental.create_state(frame(spark, first), path)
    stamp = lambda: {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "state").iterdir() if p.is_dir()}
    before = stamp()
    changes = incremental.signed(frame(spark, gone), -1).unionByName(incremental.signed(frame(spark, more), 1))
    assert incremental.apply_changes(spark, path, changes, 1) == ["2024-02"]
    after = stamp()
    assert {m for m in after if after[m] != before.get(m)} == {"month=2024-02"}  # only the changed month is written
    want = values(incremental.daily_changes(frame(spark, [r for r in first if r not in gone] + more)))
    state = incremental.read_state(spark, path)
    assert values(state) == want
    # sent again, and again after a failure that left one of two months done
    assert incremental.apply_changes(spark, path, changes, 1) == []
    two = incremental.signed(frame(spark, [(5, 3, 1, 10, "Delivered"), (6, 45, 1, 10, "Delivered")]), 1)
    half = two.where("order_date < '2024-02-01'")
    assert incremental.apply_changes(spark, path, half, 2) == ["2024-01"]
    assert incremental.apply_changes(spark, path, two, 2) == ["2024-02"]
    all_rows = [r for r in first if r not in gone] + more + [(5, 3, 1, 10, "Delivered"), (6, 45, 1, 10, "Delivered")]
    state = incremental.read_state(spark, path)
    assert values(state) == values(incremental.daily_changes(frame(spark, all_rows)))
    assert incremental.apply_changes(spark, path, two.limit(0), 3) == []
    # the analyses read the state
    days, rows = incremental.days(state), frame(spark, [r for r in all_rows if r[1] is not None])
    dated = days.where("order_date is not null")
    for f in (revenue.monthly_revenue_mom, revenue.daily_revenue, lambda d: rolling.rolling_revenue(revenue.daily_revenue(d))):
        assert sorted(map(str, f(dated).collect())) == sorted(map(str, f(rows).collect()))
