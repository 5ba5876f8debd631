"""Adapters: the driver's TPC-H-like Parquet tables seen as the domain views.

The analyses are written against the domain model (orders, suppliers,
quality inspections, machine-event and feedback documents).  These adapters
derive that model from the test tables with plain DataFrame joins and column
expressions, so every query reads the given tables and its work grows with
them.  The same mapping exists as DuckDB SQL in ``chainlens.plans.oracle``.

Two scale rules shape the builders:

* only the dimension joins a query needs are made (``dims``): every extra join
  of the fact table is one more shuffle of it at scale.  All of them are LEFT
  joins (a dimension row that is missing never removes a fact row), and order
  attributes are joined at order grain, before the lines;
* status / event-type filters are applied to the *source code* column, because
  Catalyst cannot invert a CASE mapping to push ``status = 'Delivered'`` into
  the Parquet scan (checked with ``explain``: the CASE filter stays above the
  scan).  The domain-level filter in the operator then keeps the semantics.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StringType, StructField, StructType

from chainlens.functions import constants as K

# Adapter mappings (our own, mirrored in the oracle SQL).
STATUS_BY_CODE = {"F": "Delivered", "O": "Pending", "P": "Cancelled"}
EVENT_TYPE_BY_SOURCE = {"click": "cycle_complete", "error": "alert", "purchase": "downtime_start",
                        "signup": "downtime_end", "view": "maintenance"}
CHANNELS = K.FEEDBACK_CHANNELS
ALL_DIMS = ("customer", "product", "plant")


class Tables:
    """Lazy access to ``{sf_dir}/{name}.parquet``.

    With ``database`` set, tables present there (e.g. the bucketed fact tables
    of :mod:`chainlens.sources.layout`) are read from the catalog instead, so
    their bucketing is visible to the planner.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, database: str | None = None):
        self.spark, self.sf_dir, self.database = spark, sf_dir.rstrip("/"), database
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if self.database and self.spark.catalog.tableExists(f"{self.database}.{name}"):
                self._frames[name] = self.spark.table(f"{self.database}.{name}")
            else:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]


def _map(col: Column, mapping: dict) -> Column:
    out = None
    for src, dst in mapping.items():
        out = (F.when(col == src, dst) if out is None else out.when(col == src, dst))
    return out.otherwise(col)  # an unknown code stays visible (the ENUM check reports it)


def _codes_for(values, mapping: dict) -> list:
    wanted = {values} if isinstance(values, str) else set(values)
    return [src for src, dst in mapping.items() if dst in wanted]


def _dec(text: str) -> Column:
    return F.lit(Decimal(text))


def nation_regions(t: Tables) -> DataFrame:
    """nation -> (nation name, region name); 25 rows by definition of the schema, so always broadcast."""
    return F.broadcast(t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"), "left")
                       .select("n_nationkey", "n_name", "r_name"))


def _with_customer(t: Tables, orders: DataFrame, dims) -> DataFrame:
    """Order-grain rows with the customer's segment and region; an order without its customer keeps NULLs."""
    if not {"customer", "plant"} & set(dims):
        return orders
    c = t["customer"].select("c_custkey", F.col("c_mktsegment").alias("customer"), "c_nationkey")
    df = orders.join(c, "c_custkey", "left")
    if "plant" in dims:
        nr = nation_regions(t).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("plant"))
        df = df.join(nr, "c_nationkey", "left")
    df = df.drop("c_nationkey")
    return df if "customer" in dims else df.drop("customer")


def _order_join(status) -> str:
    """Lines of unknown orders have no status: kept (LEFT) unless a status is asked for."""
    return "left" if status is None else "inner"


def net_line_revenue() -> Column:
    """round(extended price x (1 - discount), 2) in exact decimals, DECIMAL(14,2)."""
    price = F.col("l_extendedprice").cast(DecimalType(12, 2))
    disc = F.col("l_discount").cast(DecimalType(4, 2))
    return F.round(price * (F.lit(1) - disc), 2).cast(DecimalType(14, 2))


def orders_lines(t: Tables, status=None, dims=ALL_DIMS) -> DataFrame:
    """Line-grain orders: order_id, line_number, order_date, delivery_date, c_custkey,
    supplier_id, quantity, revenue, status, plus the requested ``dims``
    (customer = market segment, product = part type, plant = customer's region)."""
    o = t["orders"]
    if status is not None:
        o = o.where(F.col("o_orderstatus").isin(_codes_for(status, STATUS_BY_CODE)))
    o = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("c_custkey"),
                 F.to_date("o_orderdate").alias("order_date"),
                 _map(F.col("o_orderstatus"), STATUS_BY_CODE).alias("status"))
    li = t["lineitem"].select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
        "l_partkey", F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").alias("quantity"),
        F.to_date("l_shipdate").alias("delivery_date"), net_line_revenue().alias("revenue"))
    df = li.join(_with_customer(t, o, dims), "order_id", _order_join(status))
    if "product" in dims:
        p = t["part"].select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product"))
        df = df.join(p, "l_partkey", "left")
    return df.drop("l_partkey")


def order_totals(t: Tables, status=None, dims=("customer", "plant")) -> DataFrame:
    """Line items combined per order *before* the orders join, for analyses that only
    need order-level attributes: order_id, order_date, c_custkey, status, revenue
    (sum over the lines), line_count, revenue_count, lead_day_sum / lead_day_count
    (lead days summed over the lines), plus ``dims`` (customer, plant).

    The per-order aggregate is combined map-side and its order-key partitioning is
    reused by the join, so every later shuffle (customer join, grouping) carries
    one row per order instead of one per line.  Operators read ``line_count`` /
    ``revenue_count`` as weights, so counts and averages stay line-level.
    """
    if "product" in dims:
        raise ValueError("product is a line attribute; use orders_lines")
    ship = F.unix_date(F.to_date("l_shipdate"))
    li = (t["lineitem"].select(F.col("l_orderkey").alias("order_id"), net_line_revenue().alias("revenue"),
                               ship.alias("_ship"))
          .groupBy("order_id").agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("line_count"),
                                   F.count("revenue").alias("revenue_count"),
                                   F.sum("_ship").alias("_ship_sum"), F.count("_ship").alias("lead_day_count")))
    o = t["orders"]
    if status is not None:
        o = o.where(F.col("o_orderstatus").isin(_codes_for(status, STATUS_BY_CODE)))
    o = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("c_custkey"),
                 F.to_date("o_orderdate").alias("order_date"),
                 _map(F.col("o_orderstatus"), STATUS_BY_CODE).alias("status"))
    # sum over lines of (ship day - order day) = sum(ship days) - n x order day: exact integers
    # (lines of an unknown order have no order day: they count no lead days)
    dated = F.col("order_date").isNotNull()
    return (li.join(_with_customer(t, o, dims), "order_id", _order_join(status))
            .withColumn("lead_day_sum", F.col("_ship_sum") - F.col("lead_day_count") * F.unix_date("order_date"))
            .withColumn("lead_day_count", F.when(dated, F.col("lead_day_count")).otherwise(F.lit(0).cast("long")))
            .drop("_ship_sum"))


def order_heads(t: Tables, status=None, dims=("customer", "plant")) -> DataFrame:
    """Order-grain orders: order_id, order_date, c_custkey, revenue, status, plus ``dims``
    (customer = market segment, plant = customer's region)."""
    o = t["orders"]
    if status is not None:
        o = o.where(F.col("o_orderstatus").isin(_codes_for(status, STATUS_BY_CODE)))
    o = o.select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"),
                 F.col("o_custkey").alias("c_custkey"),
                 F.col("o_totalprice").cast(DecimalType(14, 2)).alias("revenue"),
                 _map(F.col("o_orderstatus"), STATUS_BY_CODE).alias("status"))
    return _with_customer(t, o, dims)


def _inspection_lines(t: Tables) -> DataFrame:
    return t["lineitem"].select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
        "l_partkey", F.col("l_suppkey").alias("supplier_id"),
        F.to_date("l_shipdate").alias("inspection_date"),
        F.col("l_quantity").cast("int").alias("batch_size"),
        (F.col("l_quantity").cast(DecimalType(4, 0)) * F.col("l_tax").cast(DecimalType(6, 4)))
        .cast(DecimalType(10, 4)).alias("defects_found"),
        F.col("l_tax").cast(DecimalType(6, 4)).alias("defect_rate"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("passed"))


def _inspection_dims(t: Tables, df: DataFrame, dims) -> DataFrame:
    if "product" in dims:
        p = t["part"].select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product"))
        df = df.join(p, "l_partkey", "left").drop("l_partkey")
    if "plant" in dims:
        # the supplier as a plain scan first, then the 25-row map: without statistics Spark
        # estimates a joined dimension as the product of its inputs
        s = t["supplier"].select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("n_nationkey"))
        nr = nation_regions(t).select("n_nationkey", F.col("r_name").alias("plant"))
        df = df.join(s, "supplier_id", "left").join(nr, "n_nationkey", "left").drop("n_nationkey")
    return df


def inspections(t: Tables, dims=("product", "plant")) -> DataFrame:
    """One inspection per line: order_id, inspection_id (= ``order_id-line_number``),
    line_number, supplier_id, inspection_date, batch_size, defects_found, defect_rate,
    passed, plus the requested ``dims``
    (product = part type, plant = supplier's region)."""
    li = _inspection_lines(t).withColumn("inspection_id", F.concat_ws(
        "-", F.col("order_id").cast("string"), F.col("line_number").cast("string")))
    return _inspection_dims(t, li, dims).drop("l_partkey")


def inspection_totals(t: Tables, dims=("product", "plant"), by_rate: bool = False) -> DataFrame:
    """Inspections combined per part and / or supplier *before* those tables are joined, for analyses
    per product or plant: inspection_count, defects_found, batch_size, failed, defect_rate_sum,
    defect_rate_count (sums), plus ``dims``; with ``by_rate`` one row per defect_rate, too.

    The lines are combined map-side, so the shuffle and the joins see a row per
    (part, supplier) instead of a row per line.
    """
    keys = [k for k, d in (("l_partkey", "product"), ("supplier_id", "plant")) if d in dims]
    sums = (_inspection_lines(t).groupBy(*keys, *(["defect_rate"] if by_rate else []))
            .agg(F.count(F.lit(1)).alias("inspection_count"), F.sum("defects_found").alias("defects_found"),
                 F.sum("batch_size").alias("batch_size"),
                 F.sum(F.when(F.col("passed") == 0, 1).otherwise(0)).alias("failed"),
                 F.sum("defect_rate").alias("defect_rate_sum"), F.count("defect_rate").alias("defect_rate_count")))
    return _inspection_dims(t, sums, dims).drop("supplier_id")


def suppliers(t: Tables, dims=("country",)) -> DataFrame:
    """supplier_id, supplier_name, country, tier, on_time_rate, quality_score, avg_lead_days, active.

    The test tables have no supplier tier, rates or active flag, so these are
    *derived attributes* (deterministic functions of the key and balance, fixed
    in FIXTURES.md).  Every supplier row is kept; ``active`` is only read by the
    analyses that the domain restricts to active suppliers.
    """
    k = F.col("s_suppkey")
    on_time = (_dec("0.72") + (F.lit(27) * ((k * 37) % 101)).cast(DecimalType(9, 0)) * _dec("0.0001")).cast(DecimalType(5, 3))
    quality = (_dec("3.2") + (F.col("s_acctbal") + 1000).cast(DecimalType(12, 2)) * _dec("0.00016")).cast(DecimalType(3, 2))
    src, country = t["supplier"], []
    if "country" in dims:
        nr = t["nation"].select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
        src, country = src.join(F.broadcast(nr), "s_nationkey", "left"), ["country"]
    return (src
            .select(k.alias("supplier_id"), F.col("s_name").alias("supplier_name"), *country,
                    F.concat(F.lit("Tier "), (k % 3 + 1).cast("string")).alias("tier"),
                    on_time.alias("on_time_rate"), quality.alias("quality_score"),
                    (F.lit(5) + k % 21).cast("int").alias("avg_lead_days"),
                    F.when(k % 4 == 0, 0).otherwise(1).alias("active")))


def machine_events(t: Tables, event_types=None) -> DataFrame:
    """Nested machine-event documents (event_id, timestamp, machine_id, plant, event_type,
    operator_id, metadata{shift, product_run, oee_score, duration_min, alert_code,
    sensor_readings{temperature_c, vibration_hz, pressure_bar}})."""
    e = t["events"]
    if event_types is not None:
        e = e.where(F.col("event_type").isin(_codes_for(event_types, EVENT_TYPE_BY_SOURCE)))
    k = F.get_json_object("props", "$.k").cast("int")
    src = F.col("event_type")
    hour = F.hour("ts")
    null_d = F.lit(None).cast(DoubleType())
    has_sensors = src.isin("click", "error")
    sensors = F.struct(
        F.when(has_sensors, F.col("value")).otherwise(null_d).alias("temperature_c"),
        F.when(has_sensors, (k * k) / F.lit(800)).otherwise(null_d).alias("vibration_hz"),
        F.when(has_sensors, (F.col("event_id") % 76) / F.lit(10) + F.lit(1)).otherwise(null_d).alias("pressure_bar"))
    metadata = F.struct(
        F.when(hour < 8, "Night").when(hour < 16, "Morning").otherwise("Afternoon").alias("shift"),
        F.concat(F.lit("RUN_"), F.lpad((F.col("event_id") % 10 + 1).cast("string"), 2, "0")).alias("product_run"),
        F.when(src == "click", (_dec("0.55") + _dec("0.004") * k).cast(DecimalType(6, 3)).cast("double")).alias("oee_score"),
        F.when(src.isin("purchase", "signup"), F.col("value").cast(DecimalType(10, 2)).cast("double")).alias("duration_min"),
        F.when(src == "error", F.concat(F.lit("ALT_"), (k + 100).cast("string"))).alias("alert_code"),
        sensors.alias("sensor_readings"))
    return e.select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").alias("machine_id"),
        F.concat(F.lit("Plant_"), (F.col("user_id") % 4).cast("string")).alias("plant"),
        _map(src, EVENT_TYPE_BY_SOURCE).alias("event_type"),
        F.concat(F.lit("OPR_"), F.lpad((F.col("user_id") % 30 + 1).cast("string"), 2, "0")).alias("operator_id"),
        metadata.alias("metadata"))


def customer_feedback(t: Tables, sparse_tags: bool = False) -> DataFrame:
    """Nested feedback documents (feedback_id, customer, product, date, channel, rating, tags[],
    sentiment, follow_up_required, resolution{resolved, resolution_days, owner} or NULL).

    With ``sparse_tags`` a document has the tag "clean" or none.
    """
    d = t["documents"].select("doc_id", "lang", "source", "n_chars")
    lab = t["labels"].select("doc_id", "quality", "toxic", F.lit(True).alias("_labelled"))
    j = d.join(lab, "doc_id", "left")
    doc = F.col("doc_id")
    clean = F.when(F.col("quality") == 1, F.array(F.lit("clean"))).otherwise(F.array().cast(ArrayType(StringType())))
    tags = clean if sparse_tags else F.concat(
        F.array(F.col("lang"), F.when(F.col("n_chars") >= 2000, "long").otherwise("short")), clean)
    resolution = F.when(F.col("_labelled"), F.struct(
        (F.col("quality") == 1).alias("resolved"),
        F.when(F.col("n_chars") % 10 >= 3, (F.col("n_chars") % 14 + 1).cast("int")).alias("resolution_days"),
        F.concat(F.lit("CSM_"), (doc % 5 + 1).cast("string")).alias("owner")))
    return j.select(
        doc.alias("feedback_id"), F.col("source").alias("customer"), F.col("lang").alias("product"),
        # documents carry the date as ISO text, as the feedback collection does
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (doc % 365).cast("int")), "yyyy-MM-dd").alias("date"),
        F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (doc % 4 + 1).cast("int")).alias("channel"),
        (doc % 5 + 1).cast("int").alias("rating"),
        tags.alias("tags"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .otherwise("neutral").alias("sentiment"),
        (doc % 2 == 0).alias("follow_up_required"),
        resolution.alias("resolution"))


def document_texts(docs: DataFrame, extra: Column | None = None) -> DataFrame:
    """Documents as JSON text (``text``), as a collection's export has them: absent values have no key, times
    are ISO text; ``extra`` adds a key ``source`` that the declared schema doesn't know."""
    cols = [F.date_format(c.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c.name)
            if c.dataType.simpleString().startswith("timestamp") else F.col(c.name) for c in docs.schema.fields]
    return docs.select(F.to_json(F.struct(*cols, *([extra.alias("source")] if extra is not None else []))).alias("text"))


def document_schema(docs: DataFrame) -> StructType:
    """The declared schema of such texts: times are text."""
    return StructType([StructField(f.name, StringType()) if f.dataType.simpleString().startswith("timestamp") else f
                       for f in docs.schema.fields])


def corrected_lines(t: Tables):
    """Order lines as a load and the changes after it: ``(first load, retractions, insertions)``.

    The first load has the odd lines, line 1 with a wrong price; then line 1 is taken back and put right, and the even lines arrive.
    """
    lines = orders_lines(t, dims=())
    odd, first = F.col("line_number") % 2 == 1, F.col("line_number") == 1
    wrong = F.when(first, F.col("revenue") + F.col("quantity").cast("int")).otherwise(F.col("revenue"))
    load = lines.where(odd).withColumn("revenue", wrong.cast("decimal(14,2)"))
    # each of the three reads whole tables; together they are every line
    return load, load.where(first), lines.where(first | ~odd)
