"""Fixed values.

FIXED VALUES — these must equal the reference analyses for identical results.
They are business thresholds, labels and domains, listed in natural order.
"""

# Machine event types and feedback channels of the document collections.
EVENT_TYPES = ("cycle_complete", "downtime_start", "downtime_end", "maintenance", "alert", "shift_start", "shift_end")
FEEDBACK_CHANNELS = ("email", "portal", "call", "site_visit")

# Order status domain and the status every revenue analysis keeps.
ORDER_STATUSES = ("Delivered", "Pending", "Cancelled")
DELIVERED = "Delivered"

# Supplier tier domain and column defaults of the declared schema.
SUPPLIER_TIERS = ("Tier 1", "Tier 2", "Tier 3")
COLUMN_DEFAULTS = {
    "suppliers": {"tier": "Tier 2", "active": 1},
    "orders": {"discount_pct": 0, "status": "Pending"},
    "quality_inspections": {"defects_found": 0, "defect_rate": 0, "passed": 1},
}
# Declared types of the columns that have defaults.
DEFAULT_TYPES = {
    "suppliers": {"tier": "string", "active": "tinyint"},
    "orders": {"discount_pct": "decimal(5,3)", "status": "string"},
    "quality_inspections": {"defects_found": "int", "defect_rate": "decimal(6,4)", "passed": "tinyint"},
}

# Supplier RAG: GREEN when quality >= 4.5 and on-time >= 0.95,
# AMBER when quality >= 3.8 and on-time >= 0.85, else RED.
SUPPLIER_GREEN_QUALITY = 4.5
SUPPLIER_GREEN_ONTIME = 0.95
SUPPLIER_AMBER_QUALITY = 3.8
SUPPLIER_AMBER_ONTIME = 0.85

# Quality RAG on defect %: below 1 GREEN, below 3 AMBER, else RED.
QUALITY_GREEN_BELOW = 1.0
QUALITY_AMBER_BELOW = 3.0

# OEE RAG on mean OEE: at least 0.85 GREEN, at least 0.70 AMBER, else RED.
OEE_GREEN_FROM = 0.85
OEE_AMBER_FROM = 0.70

# Customer tier on active months: 18 Champion, 12 Loyal, 6 Developing, else New / At Risk.
TIER_CHAMPION_MONTHS = 18
TIER_LOYAL_MONTHS = 12
TIER_DEVELOPING_MONTHS = 6
CUSTOMER_TIER_LABELS = ("Champion", "Loyal", "Developing", "New / At Risk")

# Sensor anomaly: more than 2 sample standard deviations from the global mean.
SENSOR_COLUMNS = ("temperature_c", "vibration_hz", "pressure_bar")
ANOMALY_SIGMAS = 2.0

# Sentiment classes pivoted per customer.
SENTIMENTS = ("negative", "neutral", "positive")

# Top-k, rolling window, SLA and dependency parameters.
TOP_K_CUSTOMERS = 5
TOP_ALERTS = 10
TOP_PRODUCTS_PER_CUSTOMER = 3
SCORECARD_LIMIT = 10
ROLLING_WINDOW_DAYS = 30
SLA_THRESHOLD_DAYS = 21
LEAD_TIME_PERCENTILE = 0.95
CRITICAL_SUPPLIER_MIN_CUSTOMERS = 3
SAMPLE_SIZE = 1000
SAMPLE_SEED = 42
UNKNOWN_TIER = "Unknown"

# Dashboard rules: top-3 highlight, chart reference lines and KPI cut-offs.
HIGHLIGHT_TOP = 3
OEE_CHART_LINES = (85.0, 70.0)
DEFECT_CHART_LINES = (3.0, 1.0)
KPI_OEE_GREEN_PCT = 85.0
KPI_DEFECT_GREEN_BELOW_PCT = 1.0
KPI_RED_MACHINES_ABOVE = 2
KPI_LEAD_GREEN_MAX_DAYS = 15.0

# Labels of the KPI table.
KPI_LABELS = ("Total Revenue (Delivered)", "Total Delivered Orders", "Avg OEE Score", "Avg Defect Rate",
              "Machines Below 70% OEE", "Avg Lead Time")

# Units: rupees per million ("Mn") and per crore ("Cr").
MILLION = 1_000_000
CRORE = 10_000_000
