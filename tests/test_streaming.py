"""The event operators over a Structured Streaming source give the batch answer."""

import os

from chainlens.operators import events
from chainlens.sources import testdata
from chainlens.streaming.events import flat_events_query, oee_query, read_event_stream


def test_streaming_oee_equals_batch(spark, tmpdir_fresh):
    t = testdata.Tables(spark, "/root/testdata/sf0.001")
    raw = testdata.machine_events(t)
    # documents carry the declared (string) ids and ISO text timestamps
    docs = raw.select(*[raw[c].cast("string").alias(c) if c in ("event_id", "machine_id") else raw[c]
                        for c in raw.columns])
    src = os.path.join(tmpdir_fresh, "in")
    docs.withColumn("timestamp", docs["timestamp"].cast("string")).write.json(src)
    stream = read_event_stream(spark, src, max_files_per_trigger=2)
    q = oee_query(stream, "oee_live", os.path.join(tmpdir_fresh, "ck1"), sink="memory")
    q.processAllAvailable()
    q.stop()
    live = {tuple(r) for r in spark.sql("SELECT * FROM oee_live").collect()}
    batch = {tuple(r) for r in events.oee_by_machine(events.flatten_events(docs)).collect()}
    assert live == batch and len(live) > 0

    q2 = flat_events_query(read_event_stream(spark, src), os.path.join(tmpdir_fresh, "out"),
                           os.path.join(tmpdir_fresh, "ck2"))
    q2.processAllAvailable()
    q2.stop()
    assert spark.read.parquet(os.path.join(tmpdir_fresh, "out")).count() == docs.count()
