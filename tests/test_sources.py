"""Readers and sinks: declared schemas, nested documents, round trips."""

import json
import os

import pytest

from chainlens.functions.classify import supplier_rag
from chainlens.operators import events, feedback
from chainlens.sources import readers, sinks, testdata

def test_supplier_csv_rag_boundaries(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "suppliers.csv")
    with open(p, "w") as f:
        f.write("supplier_id,supplier_name,country,tier,on_time_rate,quality_score,avg_lead_days,contract_value,active\n")
        rows = [("S1", 0.950, 4.50, 1), ("S2", 0.990, 4.49, 1), ("S3", 0.850, 3.80, 1), ("S4", 0.900, 3.79, 1),
                ("S5", 0.840, 4.60, 1), ("S6", 0.990, 5.00, 0)]
        for sid, ot, q, act in rows:
            f.write(f"{sid},Name {sid},India,Tier 1,{ot},{q},10,1000.00,{act}\n")
    s = readers.read_csv(spark, p, "suppliers")
    assert s.count() == 6
    got = {r.supplier_id: r.rag for r in s.where("active = 1")
           .select("supplier_id", supplier_rag("quality_score", "on_time_rate").alias("rag")).collect()}
    assert got == {"S1": "GREEN", "S2": "AMBER", "S3": "AMBER", "S4": "RED", "S5": "RED"}


def test_csv_keeps_literal_none(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "qi.csv")
    with open(p, "w") as f:
        f.write("inspection_id,order_id,product,plant,inspection_date,batch_size,defects_found,defect_type,"
                "inspector_id,passed,defect_rate\n")
        f.write("INS_1,ORD_1,Gear Box,Plant_Pune,2023-01-05,100,0,None,E1,1,0.0\n")
        f.write("INS_2,ORD_2,Gear Box,Plant_Pune,2023-01-06,100,3,,E1,0,0.03\n")
    df = readers.read_csv(spark, p, "quality_inspections")
    got = [r.defect_type for r in df.orderBy("inspection_id").collect()]
    assert got == ["None", None]
    assert str(df.schema["defect_rate"].dataType) == "DecimalType(6,4)"


def test_json_documents_flatten(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "events.json")
    docs = [{"event_id": "EVT_1", "timestamp": "2023-03-01T08:30:00", "machine_id": "MCH_001", "plant": "P",
             "event_type": "cycle_complete", "operator_id": "OPR_01",
             "metadata": {"shift": "Morning", "product_run": "Gear Box", "oee_score": 0.8, "duration_min": None,
                          "alert_code": None,
                          "sensor_readings": {"temperature_c": 70.1, "vibration_hz": 3.2, "pressure_bar": 4.1}}},
            {"event_id": "EVT_2", "timestamp": "2023-03-01T09:00:00", "machine_id": "MCH_001", "plant": "P",
             "event_type": "maintenance", "operator_id": "OPR_02",
             "metadata": {"shift": "Morning", "product_run": "Gear Box", "sensor_readings": {}}}]
    with open(p, "w") as f:
        json.dump(docs, f)
    flat = events.flatten_events(readers.read_documents(spark, p, "machine_events", multi_line=True))
    rows = flat.orderBy("event_id").collect()
    assert len(flat.columns) == 16
    assert rows[0].temperature_c == 70.1 and rows[0].month == "2023-03"
    assert rows[1].temperature_c is None and rows[1].oee_score is None


def test_feedback_null_resolution(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "fb.json")
    with open(p, "w") as f:
        for d in [{"feedback_id": "FB_1", "customer": "A", "tags": ["a", "b"], "sentiment": "negative",
                   "resolution": None},
                  {"feedback_id": "FB_2", "customer": "A", "tags": ["a"], "sentiment": "positive",
                   "resolution": {"resolved": True, "resolution_days": 4, "owner": "CSM_01"}}]:
            f.write(json.dumps(d) + "\n")
    flat = feedback.flatten_feedback(readers.read_documents(spark, p, "customer_feedback", multi_line=False))
    rows = {r.feedback_id: r for r in flat.collect()}
    assert rows["FB_1"].resolved is None and rows["FB_1"].tags == "a, b"
    assert rows["FB_2"].resolution_days == 4
    s = feedback.resolution_summary(flat).first()
    assert (s.avg_resolution_days, s.unresolved_tickets) == (4.0, 0)


def test_sinks_round_trip(spark, tmpdir_fresh):
    t = testdata.Tables(spark, "/root/testdata/sf0.001")
    docs = testdata.machine_events(t)
    sinks.write_json(docs, os.path.join(tmpdir_fresh, "j"))
    back = spark.read.schema(docs.schema).json(os.path.join(tmpdir_fresh, "j"))
    a, b = events.flatten_events(back), events.flatten_events(docs)  # JSON has no empty structs: compare the values
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    flat = events.flatten_events(docs)
    sinks.write_csv(flat, os.path.join(tmpdir_fresh, "c"))
    back = spark.read.option("header", True).schema(flat.schema).csv(os.path.join(tmpdir_fresh, "c"))
    assert back.exceptAll(flat).count() == 0 and flat.exceptAll(back).count() == 0  # values, not just counts
    sinks.write_parquet(flat, os.path.join(tmpdir_fresh, "p"), partition_by=["plant"])
    back = spark.read.parquet(os.path.join(tmpdir_fresh, "p")).select(*flat.columns)
    assert back.exceptAll(flat).count() == 0 and flat.exceptAll(back).count() == 0
    with pytest.raises(ValueError):
        sinks.write_csv(docs, os.path.join(tmpdir_fresh, "bad"))


def test_sql_registration(spark):
    t = testdata.Tables(spark, "/root/testdata/sf0.001")
    readers.register(testdata.suppliers(t), "suppliers_v")
    n = readers.run_sql(spark, "SELECT COUNT(*) AS n FROM suppliers_v WHERE active = 1").first().n
    assert n == testdata.suppliers(t).where("active = 1").count()


def test_csv_header_must_match_schema(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "bad.csv")
    with open(p, "w") as f:
        f.write("supplier_name,supplier_id,country,tier,on_time_rate,quality_score,avg_lead_days,contract_value,active\n")
        f.write("Name,S1,India,Tier 1,0.9,4.0,10,1000.00,1\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, p, "suppliers").collect()


@pytest.mark.parametrize("multi_line,text", [
    (False, '{"event_id": "E1"}\n{"event_id": \n'), (True, '[{"event_id": "E1"}, {"event_id": "E2"}'),
])
def test_malformed_documents_are_an_error(spark, tmpdir_fresh, multi_line, text):
    import os

    from chainlens.sources import readers

    path = os.path.join(tmpdir_fresh, "broken.json")
    with open(path, "w") as f:
        f.write(text)
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.read_documents(spark, path, "machine_events", multi_line=multi_line).collect()
