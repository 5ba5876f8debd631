"""Streaming readers and queries for machine-event documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chainlens.operators.events import flatten_events, oee_by_machine
from chainlens.sources import schemas


def read_event_stream(spark: SparkSession, path: str, fmt: str = "json",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Event documents arriving as files under ``path`` (declared schema, no inference)."""
    r = spark.readStream.schema(schemas.MACHINE_EVENTS).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def flat_events_query(stream: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Flatten each micro-batch and append it to ``sink_path`` (exactly-once file sink)."""
    return (flatten_events(stream).writeStream.format(fmt).outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", sink_path).start())


def oee_query(stream: DataFrame, query_name: str, checkpoint: str, sink: str) -> StreamingQuery:
    """Running OEE per machine (complete mode; state is one row per machine).

    ``sink`` is any that accepts complete mode; ``memory`` holds the whole result
    in the driver and is for tests.

    Exactly the batch operator: sorting after an aggregation is allowed in
    complete mode.
    """
    oee = oee_by_machine(flatten_events(stream))
    return (oee.writeStream.format(sink).outputMode("complete").queryName(query_name)
            .option("checkpointLocation", checkpoint).start())
