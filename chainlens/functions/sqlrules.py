"""The business rules as SQL functions, so that SQL text uses the same thresholds as the DataFrame operators.

:func:`register_rules` creates temporary SQL functions (no Python runs: the optimiser inlines their bodies, whose thresholds come from
:mod:`~chainlens.functions.constants`), to be called from ``spark.sql`` beside the registered views.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from chainlens.functions import constants as K

#: the name of every rule begins with it
PREFIX = "cl_"


def _rules() -> dict[str, str]:
    """``signature -> body``; a comparison with NULL is unknown, which falls through to the last class."""
    def below(x, green, amber):
        return f"CASE WHEN {x} < {green} THEN 'GREEN' WHEN {x} < {amber} THEN 'AMBER' ELSE 'RED' END"

    return {
        "supplier_rag(quality DOUBLE, on_time DOUBLE) RETURNS STRING":
            f"CASE WHEN quality >= {K.SUPPLIER_GREEN_QUALITY} AND on_time >= {K.SUPPLIER_GREEN_ONTIME} THEN 'GREEN' "
            f"WHEN quality >= {K.SUPPLIER_AMBER_QUALITY} AND on_time >= {K.SUPPLIER_AMBER_ONTIME} THEN 'AMBER' ELSE 'RED' END",
        "quality_rag(defect_pct DOUBLE) RETURNS STRING": below("defect_pct", K.QUALITY_GREEN_BELOW, K.QUALITY_AMBER_BELOW),
        "oee_rag(oee DOUBLE) RETURNS STRING":
            f"CASE WHEN oee >= {K.OEE_GREEN_FROM} THEN 'GREEN' WHEN oee >= {K.OEE_AMBER_FROM} THEN 'AMBER' ELSE 'RED' END",
        "lead_days(delivered DATE, ordered DATE) RETURNS INT": "datediff(delivered, ordered)",
        "half_up(x DECIMAL(38,10), places INT) RETURNS DOUBLE":
            "CASE places " + " ".join(f"WHEN {n} THEN CAST(round(x, {n}) AS DOUBLE)" for n in range(7)) + " END",
    }


def register_rules(spark: SparkSession) -> list[str]:
    """Create (or replace) the rule functions in the session; returns their names."""
    names = []
    for signature, body in _rules().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{signature} RETURN {body}")
        names.append(PREFIX + signature.split("(")[0])
    return names


#: the supplier scorecard as a user writes it over registered views; ``:active`` is a parameter
SCORECARD = """
    SELECT s.supplier_id, s.supplier_name, s.tier, s.country, CAST(s.on_time_rate AS DOUBLE) AS on_time_rate,
           CAST(s.quality_score AS DOUBLE) AS quality_score, COUNT(o.order_id) AS total_orders,
           cl_half_up(SUM(o.revenue), 2) AS total_revenue,
           cl_half_up(AVG(cl_lead_days(o.delivery_date, o.order_date)), 1) AS avg_actual_lead_days,
           CAST(s.avg_lead_days AS BIGINT) AS contracted_lead_days,
           cl_half_up(AVG(cl_lead_days(o.delivery_date, o.order_date)) - s.avg_lead_days, 1) AS lead_day_variance,
           cl_supplier_rag(s.quality_score, s.on_time_rate) AS supplier_rag
    FROM cl_suppliers s LEFT JOIN cl_orders o ON s.supplier_id = o.supplier_id
    WHERE s.active = :active
    GROUP BY s.supplier_id, s.supplier_name, s.tier, s.country, s.on_time_rate, s.quality_score, s.avg_lead_days
    ORDER BY total_revenue DESC NULLS LAST, s.supplier_id"""
