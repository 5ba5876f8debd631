"""Published results: verified, switched at the end, repeatable; partitions replaced from staged rows."""

import pytest
from pyspark.sql import functions as F

from chainlens.sources import published as pub

ROWS = [(1, "a", 1.5), (2, None, None), (3, "", -0.0), (3, "", -0.0), (None, "é,\"x\"", 1e300)]
SCHEMA = "id long, t string, x double"


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("fmt", pub.FORMATS)
def test_round_trip_and_switch(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        pub.read_published(spark, path)
    pub.publish(frame(spark), path, "r1", fmt)
    # CSV has one text for NULL and the empty string
    want = [(i, None if fmt == "csv" and t == "" else t, x) for i, t, x in ROWS]
    assert same(pub.read_published(spark, path, SCHEMA, fmt), frame(spark, want))
    pub.publish(frame(spark, ROWS[:2]), path, "r2", fmt)
    assert pub.read_published(spark, path, SCHEMA, fmt).count() == 2
    pub.publish(frame(spark, []), path, "r3", fmt)  # an empty result is a result
    assert pub.read_published(spark, path, SCHEMA, fmt).count() == 0


def test_a_failed_write_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "out")
    pub.publish(frame(spark), path, "good")
    broken = frame(spark).withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        pub.publish(broken, path, "bad")
    assert same(pub.read_published(spark, path), frame(spark))
    pub.publish(frame(spark, ROWS[:1]), path, "bad")  # the same run again, now whole
    assert pub.read_published(spark, path).count() == 1


def test_a_repeated_run_does_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    where = pub.publish(frame(spark), path, "r1")
    before = sorted(p.name for p in (tmp_path / "out" / "runs" / "r1").iterdir())
    assert pub.publish(frame(spark, ROWS[:1]), path, "r1") == where
    assert sorted(p.name for p in (tmp_path / "out" / "runs" / "r1").iterdir()) == before


def test_what_is_read_back_is_compared(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    pub.publish(frame(spark), path, "good")
    whole = pub._read
    for change in (lambda df: df.limit(4), lambda df: df.withColumn("x", F.coalesce("x", F.lit(0.0)))):
        monkeypatch.setattr(pub, "_read", lambda *a, c=change: c(whole(*a)))
        with pytest.raises(pub.VerificationError):
            pub.publish(frame(spark), path, "cut")
    monkeypatch.setattr(pub, "_read", whole)
    assert pub.current_path(spark, path).endswith("good")


def test_rows_are_computed_once(spark, tmp_path):
    n = spark.sparkContext.accumulator(0)
    count = F.udf(lambda i: (n.add(1), i)[1], "long")
    rows = spark.range(50).select(count.asNondeterministic()("id").alias("id"))
    pub.publish(rows, str(tmp_path / "out"), "r1")
    assert n.value == 50


def test_partitions_are_replaced(spark, tmp_path):
    path, staging = str(tmp_path / "table"), str(tmp_path / "staging")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, g string").write.partitionBy("g").parquet(path)
    fresh = spark.createDataFrame([(9, "a"), (10, "c")], "id long, g string")
    for _ in range(2):
        pub.replace_partitions(fresh, path, ["g"], staging, "r1")
        assert sorted((r.id, r.g) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a"), (10, "c")]
    broken = fresh.withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        pub.replace_partitions(broken, path, ["g"], staging, "r2")
    assert spark.read.parquet(path).count() == 3


def test_unfit_input(spark, tmp_path):
    with pytest.raises(ValueError):
        pub.publish(spark.sql("SELECT map(1, 2) AS m"), str(tmp_path), "r")
    with pytest.raises(ValueError):
        pub.publish(frame(spark), str(tmp_path), "../r")
    with pytest.raises(ValueError):
        pub.publish(frame(spark), str(tmp_path), "r", "xml")
