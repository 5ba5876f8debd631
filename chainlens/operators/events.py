"""Machine-event documents: flatten, OEE, downtime, alerts, sensor anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chainlens.functions import constants as K
from chainlens.functions.classify import at_least_rag
from chainlens.functions.dates import month_key
from chainlens.functions.numeric import as_long, round_half_up

FLAT_EVENT_COLUMNS = ["event_id", "timestamp", "machine_id", "plant", "event_type", "operator_id", "shift",
                      "product_run", "oee_score", "duration_min", "alert_code", "temperature_c", "vibration_hz",
                      "pressure_bar", "date", "month"]


def flatten_events(docs: DataFrame) -> DataFrame:
    """Three nesting levels -> 14 flat columns, plus calendar date and ``yyyy-MM`` month.

    Missing objects (``{}`` or absent ``metadata``) read as NULL struct fields,
    so the projection needs no defaults.  Works on batch and streaming inputs.
    """
    ts = F.col("timestamp")
    if isinstance(docs.schema["timestamp"].dataType, StringType):
        ts = F.to_timestamp_ntz(ts)
    m, s = "metadata", "metadata.sensor_readings"
    return docs.select(
        "event_id", ts.alias("timestamp"), "machine_id", "plant", "event_type", "operator_id",
        F.col(f"{m}.shift").alias("shift"), F.col(f"{m}.product_run").alias("product_run"),
        F.col(f"{m}.oee_score").alias("oee_score"), F.col(f"{m}.duration_min").alias("duration_min"),
        F.col(f"{m}.alert_code").alias("alert_code"),
        F.col(f"{s}.temperature_c").alias("temperature_c"), F.col(f"{s}.vibration_hz").alias("vibration_hz"),
        F.col(f"{s}.pressure_bar").alias("pressure_bar"),
    ).withColumn("date", F.to_date("timestamp")).withColumn("month", month_key("timestamp"))


def oee_by_machine(events: DataFrame, green_from: float = K.OEE_GREEN_FROM,
                   amber_from: float = K.OEE_AMBER_FROM) -> DataFrame:
    """cycle_complete events per machine: mean/min/max OEE (3 places) and RAG on the
    rounded mean; worst first.  NULL machine ids are dropped (pandas groupby)."""
    e = events.where((F.col("event_type") == "cycle_complete") & F.col("machine_id").isNotNull())
    g = e.groupBy("machine_id").agg(F.avg("oee_score").alias("_avg"), F.count("event_id").alias("cycles"),
                                    F.min("oee_score").alias("_min"), F.max("oee_score").alias("_max"))
    avg = round_half_up("_avg", 3)
    return (g.select("machine_id", avg.alias("avg_oee"), as_long("cycles").alias("cycles"),
                     round_half_up("_min", 3).alias("min_oee"), round_half_up("_max", 3).alias("max_oee"),
                     at_least_rag(avg, green_from, amber_from).alias("oee_rag"))
            .orderBy(F.col("avg_oee").asc_nulls_last(), "machine_id"))


def downtime_by_plant(events: DataFrame) -> DataFrame:
    """downtime_start events per plant: count, total and mean duration (2 places)."""
    e = events.where((F.col("event_type") == "downtime_start") & F.col("plant").isNotNull())
    g = e.groupBy("plant").agg(F.count("event_id").alias("_n"), F.sum("duration_min").alias("_tot"),
                               F.avg("duration_min").alias("_avg"))
    return (g.select("plant", as_long("_n").alias("downtime_events"),
                     round_half_up(F.coalesce(F.col("_tot"), F.lit(0.0)), 2).alias("total_duration"),
                     round_half_up("_avg", 2).alias("avg_duration"))
            .orderBy(F.col("total_duration").desc(), "plant"))


def top_alerts(events: DataFrame, k: int = K.TOP_ALERTS) -> DataFrame:
    """Most frequent (machine, alert code) pairs among alert events; ties by key."""
    e = events.where((F.col("event_type") == "alert") & F.col("machine_id").isNotNull()
                     & F.col("alert_code").isNotNull())
    return (e.groupBy("machine_id", "alert_code").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "machine_id", "alert_code").limit(k))


def sensor_anomaly_flags(events: DataFrame, sigmas: float = K.ANOMALY_SIGMAS,
                         sensors=K.SENSOR_COLUMNS) -> DataFrame:
    """Rows with all sensors present, each flagged 1 when |x - mean| > sigmas x sd.

    Mean and sample sd are global: one aggregate pass computes all of them in
    one row, which is put beside every event — never an ``OVER ()`` window over
    the raw rows.
    """
    rows = events.dropna("any", subset=list(sensors))
    stats = rows.agg(*[x for c in sensors for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    flags = [(F.abs(F.col(c) - F.col(f"_m_{c}")) > F.lit(sigmas) * F.col(f"_s_{c}")).cast("int").alias(f"{c}_anomaly")
             for c in sensors]
    return rows.crossJoin(F.broadcast(stats)).select("event_id", "machine_id", *sensors, *flags)  # one row


def sensor_anomaly_totals(flags: DataFrame, sensors=K.SENSOR_COLUMNS) -> DataFrame:
    """Anomaly count per sensor, one row per sensor (sensor, anomalies)."""
    names = [f"{c}_anomaly" for c in sensors]
    sums = flags.agg(*[as_long(F.sum(n)).alias(n) for n in names])
    return sums.unpivot([], names, "sensor", "anomalies")
