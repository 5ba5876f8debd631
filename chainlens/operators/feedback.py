"""Customer-feedback documents: flatten, sentiment pivot, tags, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions import constants as K
from chainlens.functions.numeric import as_long, pct, round_half_up


def flatten_feedback(docs: DataFrame) -> DataFrame:
    """12 flat columns; a NULL ``resolution`` object yields NULL resolution columns,
    the tag array becomes one ``", "``-joined string."""
    r = "resolution"
    return docs.select(
        "feedback_id", "customer", "product", "date", "channel", "rating", "sentiment",
        F.col("follow_up_required").alias("follow_up"),
        F.coalesce(F.array_join("tags", ", "), F.lit("")).alias("tags"),
        F.col(f"{r}.resolved").alias("resolved"), F.col(f"{r}.resolution_days").alias("resolution_days"),
        F.col(f"{r}.owner").alias("owner"))


def sentiment_by_customer(flat: DataFrame, sentiments=K.SENTIMENTS) -> DataFrame:
    """Per customer: a count column per sentiment (explicit pivot values -> no extra
    distinct job), total over all sentiments and the negative rate; worst first."""
    f = flat.where(F.col("customer").isNotNull() & F.col("sentiment").isNotNull())
    counts = [as_long(F.count_if(F.col("sentiment") == s)).alias(s) for s in sentiments]
    g = f.groupBy("customer").agg(*counts, as_long(F.count("sentiment")).alias("total"))
    neg = F.col("negative") if "negative" in sentiments else F.lit(0)
    return (g.withColumn("neg_rate", round_half_up(pct(neg, "total"), 1))
            .orderBy(F.col("neg_rate").desc_nulls_last(), "customer"))


def tag_frequency(docs: DataFrame, keep_empty: bool = True) -> DataFrame:
    """tag, count over all documents, most frequent first.

    As when the joined tags of a document are split again, a document without
    tags contributes one empty tag; ``keep_empty=False`` leaves it out.
    """
    tags = F.col("tags")
    if keep_empty:
        tags = F.when(F.size(F.coalesce(tags, F.array())) == 0, F.array(F.lit(""))).otherwise(tags)
    t = docs.select(F.explode(tags).alias("tag")).select(F.trim("tag").alias("tag"))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "tag")


def resolution_summary(flat: DataFrame) -> DataFrame:
    """Mean resolution days over resolved tickets and the unresolved count
    (a NULL ``resolved`` is in neither)."""
    return flat.agg(
        round_half_up(F.avg(F.when(F.col("resolved") == F.lit(True), F.col("resolution_days"))), 6)
        .alias("avg_resolution_days"),
        as_long(F.count_if(F.col("resolved") == F.lit(False))).alias("unresolved_tickets"))
