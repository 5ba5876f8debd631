"""Explicit schemas of the domain inputs (declared types, never inferred)."""

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DecimalType, DoubleType, IntegerType,
                               StringType, StructField, StructType)

SUPPLIERS = StructType([
    StructField("supplier_id", StringType(), False),
    StructField("supplier_name", StringType(), False),
    StructField("country", StringType()),
    StructField("tier", StringType()),
    StructField("on_time_rate", DecimalType(5, 3)),
    StructField("quality_score", DecimalType(3, 2)),
    StructField("avg_lead_days", IntegerType()),
    StructField("contract_value", DecimalType(12, 2)),
    StructField("active", IntegerType()),
])

ORDERS = StructType([
    StructField("order_id", StringType(), False),
    StructField("order_date", DateType(), False),
    StructField("delivery_date", DateType()),
    StructField("customer", StringType()),
    StructField("product", StringType()),
    StructField("plant", StringType()),
    StructField("supplier_id", StringType()),
    StructField("quantity", IntegerType()),
    StructField("unit_price", DecimalType(10, 2)),
    StructField("discount_pct", DecimalType(5, 3)),
    StructField("revenue", DecimalType(14, 2)),
    StructField("status", StringType()),
])

QUALITY_INSPECTIONS = StructType([
    StructField("inspection_id", StringType(), False),
    StructField("order_id", StringType()),
    StructField("product", StringType()),
    StructField("plant", StringType()),
    StructField("inspection_date", DateType()),
    StructField("batch_size", IntegerType()),
    StructField("defects_found", IntegerType()),
    StructField("defect_type", StringType()),
    StructField("inspector_id", StringType()),
    StructField("passed", IntegerType()),
    StructField("defect_rate", DecimalType(6, 4)),
])

SENSOR_READINGS = StructType([
    StructField("temperature_c", DoubleType()),
    StructField("vibration_hz", DoubleType()),
    StructField("pressure_bar", DoubleType()),
])

EVENT_METADATA = StructType([
    StructField("shift", StringType()),
    StructField("product_run", StringType()),
    StructField("oee_score", DoubleType()),
    StructField("duration_min", DoubleType()),
    StructField("alert_code", StringType()),
    StructField("sensor_readings", SENSOR_READINGS),
])

# ``timestamp`` is ISO text in the documents; it is parsed by the flatten step.
MACHINE_EVENTS = StructType([
    StructField("event_id", StringType()),
    StructField("timestamp", StringType()),
    StructField("machine_id", StringType()),
    StructField("plant", StringType()),
    StructField("event_type", StringType()),
    StructField("operator_id", StringType()),
    StructField("metadata", EVENT_METADATA),
])

RESOLUTION = StructType([
    StructField("resolved", BooleanType()),
    StructField("resolution_days", IntegerType()),
    StructField("owner", StringType()),
])

CUSTOMER_FEEDBACK = StructType([
    StructField("feedback_id", StringType()),
    StructField("customer", StringType()),
    StructField("product", StringType()),
    StructField("date", StringType()),
    StructField("channel", StringType()),
    StructField("rating", IntegerType()),
    StructField("tags", ArrayType(StringType())),
    StructField("sentiment", StringType()),
    StructField("follow_up_required", BooleanType()),
    StructField("resolution", RESOLUTION),
])

BY_NAME = {
    "suppliers": SUPPLIERS,
    "orders": ORDERS,
    "quality_inspections": QUALITY_INSPECTIONS,
    "machine_events": MACHINE_EVENTS,
    "customer_feedback": CUSTOMER_FEEDBACK,
}
