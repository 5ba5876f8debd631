"""Classification rules (RAG, tiers, chart colours) as native CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainlens.functions import constants as K
from chainlens.functions.numeric import col_


def supplier_rag(quality, on_time,
                 green=(K.SUPPLIER_GREEN_QUALITY, K.SUPPLIER_GREEN_ONTIME),
                 amber=(K.SUPPLIER_AMBER_QUALITY, K.SUPPLIER_AMBER_ONTIME)) -> Column:
    q, o = col_(quality), col_(on_time)
    return (F.when((q >= green[0]) & (o >= green[1]), "GREEN")
            .when((q >= amber[0]) & (o >= amber[1]), "AMBER")
            .otherwise("RED"))


def below_rag(value, green_below=K.QUALITY_GREEN_BELOW, amber_below=K.QUALITY_AMBER_BELOW) -> Column:
    """Lower is better: ``< green_below`` GREEN, ``< amber_below`` AMBER, else (NULL too) RED."""
    v = col_(value)
    return F.when(v < green_below, "GREEN").when(v < amber_below, "AMBER").otherwise("RED")


def at_least_rag(value, green_from=K.OEE_GREEN_FROM, amber_from=K.OEE_AMBER_FROM) -> Column:
    """Higher is better: ``>= green_from`` GREEN, ``>= amber_from`` AMBER, else (NULL too) RED."""
    v = col_(value)
    return F.when(v >= green_from, "GREEN").when(v >= amber_from, "AMBER").otherwise("RED")


def chart_defect_colour(value, red_from=K.DEFECT_CHART_LINES[0], amber_from=K.DEFECT_CHART_LINES[1]) -> Column:
    """Dashboard colour: ``>= 3`` RED, ``>= 1`` AMBER, else GREEN — NULL falls to GREEN (D3)."""
    v = col_(value)
    return F.when(v >= red_from, "RED").when(v >= amber_from, "AMBER").otherwise("GREEN")


def growth_sign_class(value) -> Column:
    """GREEN when growth (NULL read as 0) is non-negative, else RED."""
    return F.when(F.coalesce(col_(value), F.lit(0.0)) >= 0, "GREEN").otherwise("RED")


def customer_tier(active_months,
                  champion=K.TIER_CHAMPION_MONTHS, loyal=K.TIER_LOYAL_MONTHS,
                  developing=K.TIER_DEVELOPING_MONTHS) -> Column:
    m = col_(active_months)
    labels = K.CUSTOMER_TIER_LABELS
    return (F.when(m >= champion, labels[0]).when(m >= loyal, labels[1])
            .when(m >= developing, labels[2]).otherwise(labels[3]))
