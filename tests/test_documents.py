"""Documents as VARIANT: the struct path's values, one parse each, unknown keys, awkward documents."""

import json

import pytest
from pyspark.sql import functions as F

from chainlens.operators import documents as doc
from chainlens.operators import events, feedback
from chainlens.plans.catalog import QUERIES
from chainlens.sources import readers, schemas
from chainlens.sources import testdata as td

SF = "/root/testdata/sf0.001"
EVENTS = [
    {"event_id": "E1", "timestamp": "2024-02-03T04:05:06", "machine_id": "M1", "plant": "P", "event_type": "alert",
     "operator_id": "O", "firmware": "1.2", "metadata": {"shift": "Night", "oee_score": 0.5, "alert_code": "A1", "line": {"id": 7},
                                                         "sensor_readings": {"temperature_c": 70, "humidity": 0.4}}},
    {"event_id": "E2", "timestamp": "2024-02-03T04:05:06", "metadata": {}},
    {"event_id": "E3", "metadata": None, "firmware": None},
    {"event_id": "E4", "metadata": "not an object", "plant": 5},
    {"event_id": "E5", "metadata": {"oee_score": "high", "sensor_readings": [1, 2]}},
]


def lines(spark, docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "text string")


def test_values_by_path(spark):
    flat = events.flatten_events(doc.structured(doc.parse_documents(lines(spark, EVENTS)), schemas.MACHINE_EVENTS))
    got = {r.event_id: r for r in flat.collect()}
    assert flat.columns == events.FLAT_EVENT_COLUMNS and len(got) == 5
    assert (got["E1"].oee_score, got["E1"].temperature_c, got["E1"].shift, got["E1"].month) == (0.5, 70.0, "Night", "2024-02")
    assert got["E2"].shift is None and got["E3"].timestamp is None
    assert got["E4"].oee_score is None and got["E4"].plant == "5"  # a number reads as text, text as no object
    assert got["E5"].oee_score is None and got["E5"].temperature_c is None


def test_unknown_keys_are_kept(spark):
    parsed = doc.parse_documents(lines(spark, EVENTS))
    got = {(r.id, r.path): (r.kind, r.value) for r in doc.unknown_keys(parsed, schemas.MACHINE_EVENTS, "$.event_id").collect()}
    assert got == {("E1", "$.firmware"): ("STRING", '"1.2"'), ("E1", "$.metadata.line"): ("OBJECT<id: BIGINT>", '{"id":7}'),
                   ("E1", "$.metadata.sensor_readings.humidity"): ("DECIMAL(1,1)", "0.4"), ("E3", "$.firmware"): ("VOID", "null")}
    kept = doc.structured(parsed, schemas.MACHINE_EVENTS, keep=True)
    later = kept.select(F.try_variant_get("document", "$.metadata.line.id", "int").alias("i")).where("i is not null")
    assert [r.i for r in later.collect()] == [7]  # a later schema reads it without loading again


def test_malformed_documents(spark):
    bad = spark.createDataFrame([('{"event_id": ',), ('{"event_id": "E1"}',), (None,)], "text string")
    with pytest.raises(Exception, match="(?i)malformed"):
        doc.parse_documents(bad).collect()
    got = doc.structured(doc.parse_documents(bad, lenient=True), schemas.MACHINE_EVENTS).select("event_id").collect()
    assert sorted(str(r.event_id) for r in got) == ["E1", "None", "None"]
    assert doc.structured(doc.parse_documents(bad.limit(0)), schemas.MACHINE_EVENTS).count() == 0


@pytest.mark.parametrize("build, flatten", [(td.machine_events, events.flatten_events), (td.customer_feedback, feedback.flatten_feedback)])
def test_equal_to_the_struct_path(spark, build, flatten):
    docs = build(td.Tables(spark, SF))
    parsed = doc.parse_documents(td.document_texts(docs, F.struct(F.lit(1).alias("unknown"))))
    a, b = flatten(docs), flatten(doc.structured(parsed, td.document_schema(docs)))
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("name", ["events_flat_variant", "feedback_flat_variant", "document_unknown_keys"])
def test_one_parse_per_document(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1, plan


def test_variant_lines_and_arrays(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(d) for d in EVENTS) + "\n\n")
    (tmp_path / "array.json").write_text(json.dumps(EVENTS, indent=1))
    text = lambda df: sorted(r[0] for r in df.select(F.to_json("document")).collect())
    want = text(readers.read_variants(spark, str(tmp_path / "lines.json")))
    assert len(want) == 5
    readers.array_to_lines(spark, str(tmp_path / "array.json"), str(tmp_path / "converted"))
    assert text(readers.read_variants(spark, str(tmp_path / "converted"))) == want
    a = readers.read_documents(spark, str(tmp_path / "array.json"), "customer_feedback", multi_line=True)
    b = readers.read_documents(spark, str(tmp_path / "converted"), "customer_feedback")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 5


def test_rejected_csv_rows(spark, tmp_path):
    head = "supplier_id,supplier_name,country,tier,on_time_rate,quality_score,avg_lead_days,contract_value,active\n"
    bad = ["S2,Two,India,Tier 1,often,4.0,10,1.00,1", "S3,Three,India,Tier 1,0.9,4.0,10,1.00,1,extra"]
    (tmp_path / "s.csv").write_text(head + "S1,One,India,Tier 1,0.9,4.0,10,1.00,1\n" + "\n".join(bad) + "\n")
    rows, rejects = readers.read_csv_with_rejects(spark, str(tmp_path / "s.csv"), "suppliers")
    assert [r.supplier_id for r in rows.collect()] == ["S1"] and rows.columns == schemas.SUPPLIERS.names
    assert sorted(r.line for r in rejects.collect()) == bad
    assert rows.select("supplier_id").count() == 1 and rejects.count() == 2
