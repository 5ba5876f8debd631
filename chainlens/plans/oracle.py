"""DuckDB SQL for every registered query — the independent check of the Spark plans.

Each text starts from the raw test tables (pre-registered views) through views
of the domain model, written here as SQL CTEs of their own (dimensions by LEFT
JOIN: a row without its dimension stays), then states the analysis the way the reference's SQL does.  Rounded
values use HALF_UP on ``DECIMAL(38,10)`` and are returned as DOUBLE, integer
counts as BIGINT, exactly as the Spark side does.
"""

from __future__ import annotations

import re


def R(expr: str, n: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


STATUS = ("CASE o.o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Pending' "
          "WHEN 'P' THEN 'Cancelled' ELSE o.o_orderstatus END")

VIEWS = {
    "v_orders": f"""
    SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_number,
           CAST(o.o_orderdate AS DATE) AS order_date, CAST(l.l_shipdate AS DATE) AS delivery_date,
           o.o_custkey AS c_custkey, c.c_mktsegment AS customer, p.p_type AS product, r.r_name AS plant,
           l.l_suppkey AS supplier_id, l.l_quantity AS quantity,
           CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))), 2)
                AS DECIMAL(14,2)) AS revenue,
           {STATUS} AS status
    FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN part p ON l.l_partkey = p.p_partkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "v_orders_table": f"""
    SELECT o.o_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS order_date, {STATUS} AS status
    FROM orders o""",
    "v_order_heads": f"""
    SELECT o.o_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS order_date,
           o.o_custkey AS c_custkey, c.c_mktsegment AS customer, r.r_name AS plant, CAST(o.o_totalprice AS DECIMAL(14,2)) AS revenue,
           {STATUS} AS status
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "v_inspections": """
    SELECT l.l_orderkey AS order_id,
           CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS inspection_id,
           p.p_type AS product, r.r_name AS plant, l.l_suppkey AS supplier_id,
           CAST(l.l_shipdate AS DATE) AS inspection_date, CAST(l.l_quantity AS INTEGER) AS batch_size,
           CAST(CAST(l.l_quantity AS DECIMAL(4,0)) * CAST(l.l_tax AS DECIMAL(6,4)) AS DECIMAL(10,4)) AS defects_found,
           CAST(l.l_tax AS DECIMAL(6,4)) AS defect_rate,
           CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE 1 END AS passed
    FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
    LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
    LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "v_suppliers": """
    SELECT s.s_suppkey AS supplier_id, s.s_name AS supplier_name, n.n_name AS country,
           'Tier ' || CAST(s.s_suppkey % 3 + 1 AS VARCHAR) AS tier,
           CAST(0.72 + CAST(27 * ((s.s_suppkey * 37) % 101) AS DECIMAL(9,0)) * 0.0001 AS DECIMAL(5,3)) AS on_time_rate,
           CAST(3.2 + CAST(s.s_acctbal + 1000 AS DECIMAL(12,2)) * 0.00016 AS DECIMAL(3,2)) AS quality_score,
           CAST(5 + s.s_suppkey % 21 AS INTEGER) AS avg_lead_days,
           CASE WHEN s.s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS active
    FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "v_events": """
    SELECT event_id, ts AS "timestamp", user_id AS machine_id, 'Plant_' || CAST(user_id % 4 AS VARCHAR) AS plant,
           CASE event_type WHEN 'click' THEN 'cycle_complete' WHEN 'error' THEN 'alert'
                WHEN 'purchase' THEN 'downtime_start' WHEN 'signup' THEN 'downtime_end'
                WHEN 'view' THEN 'maintenance' ELSE event_type END AS event_type,
           'OPR_' || lpad(CAST(user_id % 30 + 1 AS VARCHAR), 2, '0') AS operator_id,
           CASE WHEN hour(ts) < 8 THEN 'Night' WHEN hour(ts) < 16 THEN 'Morning' ELSE 'Afternoon' END AS shift,
           'RUN_' || lpad(CAST(event_id % 10 + 1 AS VARCHAR), 2, '0') AS product_run,
           CASE WHEN event_type = 'click' THEN CAST(CAST(0.55 + 0.004 * k AS DECIMAL(6,3)) AS DOUBLE) END AS oee_score,
           CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) END
                AS duration_min,
           CASE WHEN event_type = 'error' THEN 'ALT_' || CAST(k + 100 AS VARCHAR) END AS alert_code,
           CASE WHEN event_type IN ('click', 'error') THEN value END AS temperature_c,
           CASE WHEN event_type IN ('click', 'error') THEN k * k / 800 END AS vibration_hz,
           CASE WHEN event_type IN ('click', 'error') THEN event_id % 76 / 10 + 1 END AS pressure_bar,
           CAST(ts AS DATE) AS date, strftime(ts, '%Y-%m') AS month
    FROM (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events) e""",
    "v_feedback": """
    SELECT d.doc_id AS feedback_id, d.source AS customer, d.lang AS product,
           strftime(DATE '2024-01-01' + CAST(d.doc_id % 365 AS INTEGER), '%Y-%m-%d') AS date,
           (['email', 'portal', 'call', 'site_visit'])[CAST(d.doc_id % 4 + 1 AS INTEGER)] AS channel,
           CAST(d.doc_id % 5 + 1 AS INTEGER) AS rating,
           CASE WHEN lb.toxic = 1 THEN 'negative' WHEN lb.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
           (d.doc_id % 2 = 0) AS follow_up,
           CASE WHEN lb.quality = 1
                THEN [d.lang, CASE WHEN d.n_chars >= 2000 THEN 'long' ELSE 'short' END, 'clean']
                ELSE [d.lang, CASE WHEN d.n_chars >= 2000 THEN 'long' ELSE 'short' END] END AS tag_list,
           CASE WHEN lb.doc_id IS NOT NULL THEN lb.quality = 1 END AS resolved,
           CASE WHEN lb.doc_id IS NOT NULL AND d.n_chars % 10 >= 3 THEN CAST(d.n_chars % 14 + 1 AS INTEGER) END
                AS resolution_days,
           CASE WHEN lb.doc_id IS NOT NULL THEN 'CSM_' || CAST(d.doc_id % 5 + 1 AS VARCHAR) END AS owner
    FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id""",
}

_VIEW_ORDER = list(VIEWS)


def sql(body: str, *ctes: tuple[str, str]) -> str:
    """``WITH <views used> , <ctes> <body>`` — only the adapter views the text mentions."""
    text = body + " ".join(c for _, c in ctes)
    used = [v for v in _VIEW_ORDER if re.search(rf"\b{v}\b", text)]
    parts = [f"{v} AS ({VIEWS[v]})" for v in used] + [f"{n} AS ({c})" for n, c in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


DEL = "status = 'Delivered'"
LEAD = "date_diff('day', order_date, delivery_date)"
SUPPLIER_RAG = ("CASE WHEN quality_score >= 4.5 AND on_time_rate >= 0.95 THEN 'GREEN' "
                "WHEN quality_score >= 3.8 AND on_time_rate >= 0.85 THEN 'AMBER' ELSE 'RED' END")


def _below_rag(x, g, a):
    return f"CASE WHEN {x} < {g} THEN 'GREEN' WHEN {x} < {a} THEN 'AMBER' ELSE 'RED' END"


def _defects(g, a):
    rate = "SUM(defects_found) * 100.0 / NULLIF(SUM(batch_size), 0)"
    return sql(f"""
    SELECT product, plant, CAST(COUNT(inspection_id) AS BIGINT) AS total_inspections,
           CAST(SUM(defects_found) AS DOUBLE) AS total_defects, CAST(SUM(batch_size) AS BIGINT) AS total_units,
           {R(rate, 3)} AS defect_rate_pct,
           CAST(SUM(CASE WHEN passed = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed_inspections,
           {R("SUM(CASE WHEN passed = 0 THEN 1 ELSE 0 END) * 100.0 / COUNT(inspection_id)", 2)} AS failure_rate_pct,
           {_below_rag(rate, g, a)} AS quality_rag
    FROM v_inspections GROUP BY product, plant""")


def _defects_rounded(g, a):
    return sql(f"""
    SELECT *, {_below_rag("defect_rate_pct", g, a)} AS quality_rag FROM (
      SELECT product, plant, CAST(COUNT(inspection_id) AS BIGINT) AS inspections,
             CAST(SUM(defects_found) AS DOUBLE) AS total_defects, CAST(SUM(batch_size) AS BIGINT) AS total_units,
             {R("CAST(SUM(defects_found) AS DOUBLE) / NULLIF(SUM(batch_size), 0) * 100", 3)} AS defect_rate_pct,
             {R("SUM(CASE WHEN passed = 0 THEN 1.0 ELSE 0.0 END) / COUNT(inspection_id) * 100", 2)} AS failure_rate_pct
      FROM v_inspections GROUP BY product, plant) x""")


def _scorecard_join():
    return ("FROM v_suppliers s LEFT JOIN v_orders o ON s.supplier_id = o.supplier_id WHERE s.active = 1")


def _cohort(where, cust="c_custkey"):
    """One aggregate over the order lines, stated from the output columns."""
    month = "strftime(order_date, '%Y-%m')"
    return sql(f"""
    SELECT {cust}, CAST(COUNT(DISTINCT {month}) AS BIGINT) AS active_months, CAST(COUNT(order_id) AS BIGINT) AS total_orders,
           {R("SUM(revenue)", 2)} AS lifetime_value,
           {R(f"SUM(revenue) / COUNT(DISTINCT COALESCE({month}, '-')) FILTER (WHERE revenue IS NOT NULL)", 2)}
               AS avg_monthly_revenue,
           MIN({month}) AS first_order_month, MAX({month}) AS last_order_month,
           CASE WHEN COUNT(DISTINCT {month}) >= 18 THEN 'Champion' WHEN COUNT(DISTINCT {month}) >= 12 THEN 'Loyal'
                WHEN COUNT(DISTINCT {month}) >= 6 THEN 'Developing' ELSE 'New / At Risk' END AS customer_tier
    FROM v_orders {where} GROUP BY {cust}""")


def _plant(dedup: bool, slim: bool):
    if dedup:
        body_from = "FROM v_order_heads o LEFT JOIN ins i ON o.order_id = i.order_id"
        rev, aov = "SUM(o.revenue)", "AVG(o.revenue)"
        adr = "SUM(i.sdr) * 100.0 / SUM(i.cdr)"
        failed = "COALESCE(SUM(i.failed), 0)"
        ctes = [("ins", """SELECT order_id, SUM(defect_rate) AS sdr, COUNT(defect_rate) AS cdr,
                 SUM(CASE WHEN passed = 0 THEN 1 ELSE 0 END) AS failed FROM v_inspections GROUP BY order_id""")]
    else:
        body_from = "FROM v_order_heads o LEFT JOIN v_inspections qi ON o.order_id = qi.order_id"
        rev, aov = "SUM(o.revenue)", "AVG(o.revenue)"
        adr = "AVG(qi.defect_rate) * 100"
        failed = "SUM(CASE WHEN qi.passed = 0 THEN 1 ELSE 0 END)"
        ctes = []
    cols = [f"o.plant", "CAST(COUNT(DISTINCT o.order_id) AS BIGINT) AS total_orders", f"{R(rev, 2)} AS total_revenue"]
    if not slim:
        cols.append(f"{R(aov, 2)} AS avg_order_value")
    cols += ["CAST(COUNT(DISTINCT o.customer) AS BIGINT) AS unique_customers", f"{R(adr, 3)} AS avg_defect_rate_pct"]
    if not slim:
        cols.append(f"CAST({failed} AS BIGINT) AS failed_batches")
    return sql(f"SELECT {', '.join(cols)} {body_from} WHERE o.{DEL} GROUP BY o.plant", *ctes)


OEE_CTE = lambda g, a: ("oee", f"""
    SELECT machine_id, {R("av", 3)} AS avg_oee, CAST(cycles AS BIGINT) AS cycles, {R("mn", 3)} AS min_oee,
           {R("mx", 3)} AS max_oee,
           CASE WHEN {R("av", 3)} >= {g} THEN 'GREEN' WHEN {R("av", 3)} >= {a} THEN 'AMBER' ELSE 'RED' END AS oee_rag
    FROM (SELECT machine_id, AVG(oee_score) AS av, COUNT(event_id) AS cycles, MIN(oee_score) AS mn,
                 MAX(oee_score) AS mx
          FROM v_events WHERE event_type = 'cycle_complete' AND machine_id IS NOT NULL GROUP BY machine_id) g""")

SENSORS = ("temperature_c", "vibration_hz", "pressure_bar")
FLAGS_CTES = [
    ("sx", "SELECT * FROM v_events WHERE temperature_c IS NOT NULL AND vibration_hz IS NOT NULL "
           "AND pressure_bar IS NOT NULL"),
    ("st", "SELECT " + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in SENSORS) + " FROM sx"),
    ("flags", "SELECT sx.event_id, sx.machine_id, " + ", ".join(f"sx.{c}" for c in SENSORS) + ", "
     + ", ".join(f"CAST(ABS(sx.{c} - st.m_{c}) > 2.0 * st.s_{c} AS INTEGER) AS {c}_anomaly" for c in SENSORS)
     + " FROM sx CROSS JOIN st"),
]

EDGES = lambda cust: ("e", f"""SELECT supplier_id, {cust} AS customer, {R("SUM(revenue)", 2)} AS total_revenue
    FROM v_orders WHERE {DEL} AND supplier_id IS NOT NULL AND {cust} IS NOT NULL GROUP BY 1, 2""")

DAILY = ("d", f"""SELECT order_date AS date, SUM(revenue) AS revenue FROM v_orders
    WHERE {DEL} AND order_date IS NOT NULL GROUP BY 1""")
ROLLING = ("r", f"""SELECT date, CAST(revenue AS DOUBLE) AS revenue, {R("SUM(revenue) OVER w", 2)} AS rolling_30d_revenue,
    {R("SUM(revenue) OVER w / 1000000", 3)} AS rolling_30d_revenue_mn
    FROM d WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""")

MONTHLY_ORDERS = ("mo", f"""SELECT month, revenue, orders,
    {R("(revenue - LAG(revenue) OVER (ORDER BY month)) / NULLIF(LAG(revenue) OVER (ORDER BY month), 0) * 100", 2)}
        AS mom_growth_pct
    FROM (SELECT strftime(order_date, '%Y-%m') AS month, {R("SUM(revenue)", 2)} AS revenue,
                 CAST(COUNT(order_id) AS BIGINT) AS orders FROM v_orders WHERE {DEL} GROUP BY 1) m""")

SAMPLE = ("smp", """SELECT substring(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 16) AS sample_key,
           l_orderkey AS order_id, l_linenumber AS line_number, l_suppkey AS supplier_id
    FROM lineitem WHERE l_suppkey IS NOT NULL
    ORDER BY sample_key, order_id, line_number, supplier_id LIMIT 1000""")

SUPPLIER_AGG = ("sa", f"""SELECT a.supplier_id, s.tier, s.country, CAST(s.quality_score AS DOUBLE) AS quality_score,
    CAST(s.on_time_rate AS DOUBLE) AS on_time_rate, CAST(a.rev AS DOUBLE) AS total_revenue,
    CAST(a.order_count AS BIGINT) AS order_count, {R("a.avg_lead", 6)} AS avg_lead_days
    FROM (SELECT supplier_id, SUM(revenue) AS rev, COUNT(*) AS order_count, AVG({LEAD}) AS avg_lead
          FROM v_orders WHERE {DEL} GROUP BY supplier_id) a JOIN v_suppliers s ON a.supplier_id = s.supplier_id""")

OLS_CTES = [
    ("mt", f"""SELECT revenue, ROW_NUMBER() OVER (ORDER BY month) AS t FROM (
        SELECT date_trunc('month', order_date) AS month, SUM(revenue) AS revenue FROM v_orders
        WHERE {DEL} GROUP BY 1) m"""),
    ("s0", "SELECT COUNT(*) AS n, SUM(t) AS st, SUM(t * t) AS stt, SUM(revenue) AS sy, "
           "SUM(revenue * revenue) AS syy, SUM(revenue * t) AS sty FROM mt"),
    ("s1", "SELECT CAST(n AS DOUBLE) AS n, CAST(st AS DOUBLE) AS st, CAST(sy AS DOUBLE) AS sy, "
           "CAST(n * stt - st * st AS DOUBLE) AS sxx_n, CAST(n * sty - st * sy AS DOUBLE) AS sxy_n, "
           "CAST(n * syy - sy * sy AS DOUBLE) AS syy_n FROM s0"),
    ("s2", "SELECT *, sxy_n / NULLIF(sxx_n, 0) AS slope FROM s1"),
    ("s3", "SELECT *, (sy - slope * st) / NULLIF(n, 0) AS intercept, "
           "sxy_n * sxy_n / NULLIF(sxx_n * syy_n, 0) AS r_squared, "
           "((syy_n - slope * sxy_n) / NULLIF(n, 0)) / NULLIF(n - 2.0, 0) AS sigma2 FROM s2"),
    ("s4", "SELECT *, sqrt(sigma2 * n / NULLIF(sxx_n, 0)) AS se_slope, "
           "sqrt(sigma2 * (1.0 / NULLIF(n, 0) + st * st / NULLIF(n * sxx_n, 0))) AS se_intercept FROM s3"),
]


# Two-sided p-value of t with df degrees of freedom: the finite sum over powers of cos(theta), its
# coefficients written with the gamma function.
PVALUE = """greatest(0, 1 - CASE WHEN df % 2 = 0 THEN sin(theta) * list_sum(list_transform(range(df // 2),
        lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(theta), 2 * k)))
    ELSE 2 / pi() * (theta + sin(theta) * cos(theta) * coalesce(list_sum(list_transform(range((df - 1) // 2),
        lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(theta), 2 * k))), 0)) END)"""


def _six(expr: str, where: str) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    return sql(f"""SELECT {R(f"MIN({x})", 6)} AS "min", {R(f"quantile_cont({x}, 0.25)", 6)} AS q1,
        {R(f"quantile_cont({x}, 0.5)", 6)} AS median, {R(f"AVG({expr})", 6)} AS mean,
        {R(f"quantile_cont({x}, 0.75)", 6)} AS q3, {R(f"MAX({x})", 6)} AS "max"
        FROM v_orders WHERE {where}""")


def _revenue_by(cust: str) -> str:
    return sql(f"""
        SELECT {cust}, CAST(n AS BIGINT) AS total_orders, CAST(rev AS DOUBLE) AS total_revenue,
               {R("av", 2)} AS avg_order_value, {R("rev * 100.0 / SUM(rev) OVER ()", 2)} AS revenue_share_pct,
               {R(f"SUM(rev) OVER (ORDER BY rev DESC, {cust} ROWS UNBOUNDED PRECEDING)", 2)} AS running_total
        FROM agg""", ("agg", f"""SELECT {cust}, COUNT(order_id) AS n, SUM(revenue) AS rev, AVG(revenue) AS av
                          FROM v_orders WHERE {DEL} GROUP BY {cust}"""))


def _top_customers(cust: str) -> str:
    return sql(f"""
        SELECT {cust}, CAST(revenue AS DOUBLE) AS revenue,
               CAST(ROW_NUMBER() OVER (ORDER BY revenue DESC, {cust}) AS BIGINT) AS rank
        FROM (SELECT {cust}, SUM(revenue) AS revenue FROM v_orders WHERE {DEL} AND {cust} IS NOT NULL
              GROUP BY {cust} ORDER BY revenue DESC, {cust} LIMIT 5) t""")


def _network(cust: str) -> str:
    return sql(f"""
        SELECT CAST(ns + nc AS BIGINT) AS num_nodes, CAST(ne AS BIGINT) AS num_edges, CAST(ns AS BIGINT) AS num_suppliers,
               CAST(nc AS BIGINT) AS num_customers, {R("ne * 1.0 / NULLIF(ns, 0)", 4)} AS avg_degree
        FROM (SELECT (SELECT COUNT(DISTINCT supplier_id) FROM e) AS ns, (SELECT COUNT(*) FROM e) AS ne,
                     (SELECT COUNT(DISTINCT {cust}) FROM v_orders WHERE {DEL}) AS nc) x""", EDGES(cust))


def _dependency(cust: str) -> str:
    return sql("""
        SELECT e.supplier_id, e.customer, e.total_revenue,
               CASE WHEN s.supplier_id IS NULL THEN 'Unknown' ELSE s.tier END AS tier
        FROM e LEFT JOIN v_suppliers s ON e.supplier_id = s.supplier_id""", EDGES(cust))


def _cohort_segment() -> str:
    return _cohort(f"WHERE {DEL}", "customer")


ORACLE: dict[str, str] = {
    "revenue_by_customer": _revenue_by("customer"),
    "revenue_by_customer_key": _revenue_by("c_custkey"),
    "revenue_by_customer_share": sql(f"""
        SELECT customer, CAST(COUNT(order_id) AS BIGINT) AS total_orders, {R("SUM(revenue)", 2)} AS total_revenue,
               {R("AVG(revenue)", 2)} AS avg_order_value,
               {R(f"SUM(revenue) * 100.0 / (SELECT SUM(revenue) FROM v_orders WHERE {DEL})", 2)} AS revenue_share_pct
        FROM v_orders WHERE {DEL} GROUP BY customer"""),
    "supplier_scorecard": sql(f"""
        SELECT s.supplier_id, s.supplier_name, s.tier, s.country, CAST(s.on_time_rate AS DOUBLE) AS on_time_rate,
               CAST(s.quality_score AS DOUBLE) AS quality_score, CAST(COUNT(o.order_id) AS BIGINT) AS total_orders,
               {R("SUM(o.revenue)", 2)} AS total_revenue,
               {R("AVG(date_diff('day', o.order_date, o.delivery_date))", 1)} AS avg_actual_lead_days,
               CAST(s.avg_lead_days AS BIGINT) AS contracted_lead_days,
               {R("AVG(date_diff('day', o.order_date, o.delivery_date)) - s.avg_lead_days", 1)} AS lead_day_variance,
               {SUPPLIER_RAG.replace("quality_score", "s.quality_score").replace("on_time_rate", "s.on_time_rate")}
                   AS supplier_rag
        {_scorecard_join()}
        GROUP BY s.supplier_id, s.supplier_name, s.tier, s.country, s.on_time_rate, s.quality_score, s.avg_lead_days"""),
    "supplier_scorecard_top10": sql(f"""
        SELECT s.supplier_id, s.tier, s.country, {R("s.on_time_rate * 100", 1)} AS on_time_pct,
               CAST(s.quality_score AS DOUBLE) AS quality_score, CAST(COUNT(o.order_id) AS BIGINT) AS total_orders,
               {R("SUM(o.revenue)", 2)} AS total_revenue,
               {R("AVG(date_diff('day', o.order_date, o.delivery_date))", 1)} AS avg_lead_days,
               {SUPPLIER_RAG.replace("quality_score", "s.quality_score").replace("on_time_rate", "s.on_time_rate")}
                   AS supplier_rag
        {_scorecard_join()}
        GROUP BY s.supplier_id, s.tier, s.country, s.on_time_rate, s.quality_score
        ORDER BY total_revenue DESC NULLS LAST, s.supplier_id LIMIT 10"""),
    "monthly_revenue_mom": sql(f"""
        SELECT month, {R("revenue", 2)} AS revenue, CAST(LAG(revenue) OVER (ORDER BY month) AS DOUBLE) AS prev_month_revenue,
               {R("(revenue - LAG(revenue) OVER (ORDER BY month)) / NULLIF(LAG(revenue) OVER (ORDER BY month), 0) * 100", 2)}
                   AS mom_growth_pct
        FROM monthly""", ("monthly", f"""SELECT strftime(order_date, '%Y-%m') AS month, SUM(revenue) AS revenue
                              FROM v_orders WHERE {DEL} GROUP BY 1""")),
    "monthly_revenue_orders": sql("SELECT * FROM mo", MONTHLY_ORDERS),
    "defects_by_product_plant": _defects(1.0, 3.0),
    "defects_by_product_plant_rounded": _defects_rounded(1.0, 3.0),
    "defects_by_product_plant_cutoffs": _defects(3.97, 4.02),
    "defects_by_product_plant_rounded_cutoffs": _defects_rounded(3.97, 4.02),
    "top_products_per_customer": sql(f"""
        SELECT * FROM (
          SELECT customer, product, CAST(rev AS DOUBLE) AS product_revenue,
                 CAST(RANK() OVER (PARTITION BY customer ORDER BY rev DESC) AS BIGINT) AS product_rank_within_customer
          FROM (SELECT customer, product, SUM(revenue) AS rev FROM v_orders WHERE {DEL} GROUP BY 1, 2) g) r
        WHERE product_rank_within_customer <= 3"""),
    "top_products_per_customer_by_key": sql(f"""
        SELECT * FROM (
          SELECT c_custkey, product, CAST(rev AS DOUBLE) AS product_revenue,
                 CAST(RANK() OVER (PARTITION BY c_custkey ORDER BY rev DESC) AS BIGINT) AS product_rank_within_customer
          FROM (SELECT c_custkey, product, SUM(revenue) AS rev FROM v_orders WHERE {DEL} GROUP BY 1, 2) g) r
        WHERE product_rank_within_customer <= 3"""),
    "customer_months": sql(f"""
        SELECT customer, strftime(order_date, '%Y-%m') AS order_month, CAST(COUNT(order_id) AS BIGINT) AS orders_in_month,
               CAST(SUM(revenue) AS DOUBLE) AS revenue_in_month
        FROM v_orders WHERE {DEL} GROUP BY 1, 2"""),
    "customer_cohort": _cohort(f"WHERE {DEL}"),
    "customer_cohort_all_status": _cohort(""),
    "customer_cohort_segment": _cohort_segment(),
    "plant_efficiency": _plant(False, False),
    "plant_efficiency_slim": _plant(False, True),
    "plant_efficiency_dedup": _plant(True, False),
    "events_flat": sql("SELECT * FROM v_events"),
    "oee_by_machine": sql("SELECT * FROM oee", OEE_CTE(0.85, 0.70)),
    "oee_by_machine_cutoffs": sql("SELECT * FROM oee", OEE_CTE(0.76, 0.73)),
    "oee_bottom5": sql("SELECT * FROM oee ORDER BY avg_oee, machine_id LIMIT 5", OEE_CTE(0.85, 0.70)),
    "downtime_by_plant": sql(f"""
        SELECT plant, CAST(COUNT(event_id) AS BIGINT) AS downtime_events,
               {R("COALESCE(SUM(duration_min), 0)", 2)} AS total_duration, {R("AVG(duration_min)", 2)} AS avg_duration
        FROM v_events WHERE event_type = 'downtime_start' AND plant IS NOT NULL GROUP BY plant"""),
    "top_alerts": sql("""
        SELECT machine_id, alert_code, CAST(COUNT(*) AS BIGINT) AS "count" FROM v_events
        WHERE event_type = 'alert' AND machine_id IS NOT NULL AND alert_code IS NOT NULL
        GROUP BY 1, 2 ORDER BY "count" DESC, machine_id, alert_code LIMIT 10"""),
    "sensor_anomaly_flags": sql("SELECT * FROM flags", *FLAGS_CTES),
    "sensor_anomaly_totals": sql(" UNION ALL ".join(
        f"SELECT '{c}_anomaly' AS sensor, CAST(SUM({c}_anomaly) AS BIGINT) AS anomalies FROM flags" for c in SENSORS),
        *FLAGS_CTES),
    "feedback_flat": sql("""
        SELECT feedback_id, customer, product, date, channel, rating, sentiment, follow_up,
               array_to_string(tag_list, ', ') AS tags, resolved, resolution_days, owner FROM v_feedback"""),
    "sentiment_by_customer": sql(f"""
        SELECT customer, CAST(COUNT(*) FILTER (WHERE sentiment = 'negative') AS BIGINT) AS negative,
               CAST(COUNT(*) FILTER (WHERE sentiment = 'neutral') AS BIGINT) AS neutral,
               CAST(COUNT(*) FILTER (WHERE sentiment = 'positive') AS BIGINT) AS positive,
               CAST(COUNT(sentiment) AS BIGINT) AS total,
               {R("COUNT(*) FILTER (WHERE sentiment = 'negative') * 100.0 / COUNT(sentiment)", 1)} AS neg_rate
        FROM v_feedback WHERE customer IS NOT NULL AND sentiment IS NOT NULL GROUP BY customer"""),
    "sentiment_top5": sql(f"""
        SELECT customer, CAST(COUNT(sentiment) AS BIGINT) AS total,
               {R("COUNT(*) FILTER (WHERE sentiment = 'negative') * 100.0 / COUNT(sentiment)", 1)} AS neg_rate
        FROM v_feedback WHERE customer IS NOT NULL AND sentiment IS NOT NULL GROUP BY customer
        ORDER BY neg_rate DESC NULLS LAST, customer LIMIT 5"""),
    "tag_top5": sql("""
        SELECT trim(tag) AS tag, CAST(COUNT(*) AS BIGINT) AS "count"
        FROM (SELECT unnest(tag_list) AS tag FROM v_feedback) u GROUP BY 1 ORDER BY "count" DESC, tag LIMIT 5"""),
    "tag_frequency": sql("""
        SELECT trim(tag) AS tag, CAST(COUNT(*) AS BIGINT) AS "count"
        FROM (SELECT unnest(tag_list) AS tag FROM v_feedback) u GROUP BY 1"""),
    "tag_frequency_sparse": """
        SELECT tag, CAST(COUNT(*) AS BIGINT) AS "count" FROM (
          SELECT CASE WHEN lb.quality = 1 THEN 'clean' ELSE '' END AS tag
          FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id) x GROUP BY tag""",
    "resolution_summary": sql(f"""
        SELECT {R("AVG(CASE WHEN resolved THEN resolution_days END)", 6)} AS avg_resolution_days,
               CAST(COUNT(*) FILTER (WHERE resolved = false) AS BIGINT) AS unresolved_tickets FROM v_feedback"""),
    "orders_enriched": sql(f"""
        SELECT o.order_id, o.line_number, o.supplier_id, o.customer, CAST(o.revenue AS DOUBLE) AS revenue,
               CASE WHEN s.supplier_id IS NULL THEN 'Unknown' ELSE s.tier END AS supplier_tier,
               CAST(s.quality_score AS DOUBLE) AS supplier_quality, CAST(s.on_time_rate AS DOUBLE) AS supplier_ontime
        FROM v_orders o LEFT JOIN v_suppliers s ON o.supplier_id = s.supplier_id WHERE o.{DEL}"""),
    "sampled_supplier_ids": sql("SELECT * FROM smp", SAMPLE),
    "supplier_lookup": sql("""
        SELECT smp.sample_key, smp.order_id, smp.line_number, smp.supplier_id, s.supplier_name, s.tier,
               CAST(s.quality_score AS DOUBLE) AS quality_score, CAST(s.on_time_rate AS DOUBLE) AS on_time_rate
        FROM smp LEFT JOIN v_suppliers s ON smp.supplier_id = s.supplier_id""", SAMPLE),
    "top_customers": _top_customers("customer"),
    "top_customers_by_key": _top_customers("c_custkey"),
    "daily_revenue": sql("SELECT date, CAST(revenue AS DOUBLE) AS revenue FROM d", DAILY),
    "rolling_30d_revenue": sql("SELECT * FROM r", DAILY, ROLLING),
    "rolling_summary": sql(f"""
        SELECT CAST(COUNT(*) AS BIGINT) AS n_days, {R("MAX(rolling_30d_revenue)", 2)} AS peak_rolling_revenue,
               {R("AVG(CAST(rolling_30d_revenue AS DECIMAL(24,2)))", 2)} AS avg_rolling_revenue FROM r""", DAILY, ROLLING),
    "sla_breach": sql(f"""
        SELECT CAST(21 AS BIGINT) AS threshold_days, CAST(COUNT(*) AS BIGINT) AS total,
               CAST(COUNT(*) FILTER (WHERE lead_days > 21) AS BIGINT) AS breaches,
               {R("COUNT(*) FILTER (WHERE lead_days > 21) * 100.0 / COUNT(*)", 4)} AS breach_pct,
               CAST(COUNT(*) FILTER (WHERE lead_days <= 21) AS BIGINT) AS within_sla,
               {R("100 - COUNT(*) FILTER (WHERE lead_days > 21) * 100.0 / COUNT(*)", 4)} AS within_pct
        FROM l""", ("l", f"SELECT {LEAD} AS lead_days FROM v_orders WHERE {DEL} AND {LEAD} IS NOT NULL")),
    "lead_time_stats": sql(f"""
        SELECT {R("AVG(lead_days)", 4)} AS avg_lead_days, {R("quantile_cont(lead_days, 0.95)", 4)} AS p95_lead_days
        FROM l""", ("l", f"SELECT {LEAD} AS lead_days FROM v_orders WHERE {DEL} AND {LEAD} IS NOT NULL")),
    "supplier_adjacency": sql("""
        SELECT supplier_id, CAST(COUNT(*) OVER (PARTITION BY supplier_id) AS BIGINT) AS n_customers,
               CAST(customer AS VARCHAR) AS customer FROM e""", EDGES("customer")),
    "supplier_edges": sql("SELECT * FROM e", EDGES("customer")),
    "supplier_edges_by_key": sql("SELECT * FROM e", EDGES("c_custkey")),
    "network_stats": _network("customer"),
    "network_stats_by_key": _network("c_custkey"),
    "critical_suppliers": sql("""
        SELECT * FROM (SELECT supplier_id, CAST(COUNT(*) OVER (PARTITION BY supplier_id) AS BIGINT) AS n_customers,
                              CAST(customer AS VARCHAR) AS customer FROM e) x WHERE n_customers >= 3""", EDGES("customer")),
    "critical_suppliers_by_key": sql("""
        SELECT supplier_id, CAST(COUNT(*) AS BIGINT) AS n_customers FROM e GROUP BY supplier_id
        HAVING COUNT(*) >= 200""", EDGES("c_custkey")),
    "supplier_dependency": _dependency("customer"),
    "supplier_dependency_by_key": _dependency("c_custkey"),
    "revenue_summary": _six("revenue", DEL),
    "lead_time_summary": _six(LEAD, DEL),
    "supplier_aggregate": sql("SELECT * FROM sa", SUPPLIER_AGG),
    "supplier_correlations": sql(f"""
        SELECT {R("CASE WHEN VAR_SAMP(quality_score) > 0 AND VAR_SAMP(total_revenue) > 0 THEN CORR(quality_score, total_revenue) END", 6)}
                   AS r_quality_revenue,
               {R("CASE WHEN VAR_SAMP(on_time_rate) > 0 AND VAR_SAMP(total_revenue) > 0 THEN CORR(on_time_rate, total_revenue) END", 6)}
                   AS r_ontime_revenue
        FROM sa""", SUPPLIER_AGG),
    "defect_stats_by_product": sql(f"""
        SELECT product, {R("AVG(defect_rate)", 6)} AS mean_defect_rate,
               {R("quantile_cont(CAST(defect_rate AS DOUBLE), 0.5)", 6)} AS median_defect_rate,
               {R("STDDEV_SAMP(defect_rate)", 6)} AS sd_defect_rate, {R("SUM(defects_found)", 6)} AS total_defects,
               CAST(SUM(batch_size) AS BIGINT) AS total_units,
               {R("SUM(defects_found) / NULLIF(SUM(batch_size), 0)", 6)} AS overall_rate
        FROM v_inspections GROUP BY product"""),
    "monthly_trend": sql(f"""
        SELECT CAST(month AS DATE) AS month, CAST(revenue AS DOUBLE) AS revenue,
               CAST(ROW_NUMBER() OVER (ORDER BY month) AS BIGINT) AS t
        FROM (SELECT date_trunc('month', order_date) AS month, SUM(revenue) AS revenue FROM v_orders
              WHERE {DEL} GROUP BY 1) m"""),
    "revenue_trend_ols": sql(f"""
        SELECT '(Intercept)' AS term, {R("intercept", 4)} AS estimate, {R("se_intercept", 4)} AS std_error,
               {R("intercept / NULLIF(se_intercept, 0)", 4)} AS t_value FROM s4
        UNION ALL
        SELECT 't', {R("slope", 4)}, {R("se_slope", 4)}, {R("slope / NULLIF(se_slope, 0)", 4)} FROM s4""", *OLS_CTES),
    "revenue_trend_pvalues": sql(f"""
        SELECT term, {R("est", 4)} AS estimate, {R("se", 4)} AS std_error, {R("est / NULLIF(se, 0)", 4)} AS t_value,
               {R(f"CASE WHEN df > 0 AND theta IS NOT NULL THEN {PVALUE} END", 8)} AS p_value FROM th""", *OLS_CTES,
        ("cf", """SELECT '(Intercept)' AS term, intercept AS est, se_intercept AS se, n FROM s4
                  UNION ALL SELECT 't', slope, se_slope, n FROM s4"""),
        ("th", """SELECT *, CAST(n - 2 AS INTEGER) AS df, atan(abs(est / NULLIF(se, 0)) / sqrt(NULLIF(n - 2, 0))) AS theta
                  FROM cf""")),
    "revenue_trend_fit": sql(f"""
        SELECT CAST(n AS BIGINT) AS n_months, {R("r_squared", 6)} AS r_squared, {R("slope", 4)} AS monthly_trend
        FROM s4""", *OLS_CTES),
    "panel_monthly": sql(f"""
        SELECT month, strftime(strptime(month, '%Y-%m'), '%b-%y') AS month_label,
               {R("revenue / 1000000", 6)} AS revenue_mn, COALESCE(mom_growth_pct, 0.0) AS growth_pct,
               CASE WHEN COALESCE(mom_growth_pct, 0.0) >= 0 THEN 'GREEN' ELSE 'RED' END AS growth_class
        FROM mo""", MONTHLY_ORDERS),
    "panel_oee": sql(f"""
        SELECT machine_id, {R("avg_oee * 100", 4)} AS oee_pct, oee_rag, CAST(85.0 AS DOUBLE) AS world_class_line,
               CAST(70.0 AS DOUBLE) AS threshold_line FROM oee""", OEE_CTE(0.85, 0.70)),
    "panel_defects": sql(f"""
        SELECT product, {R("x", 6)} AS defect_pct,
               CASE WHEN x >= 3 THEN 'RED' WHEN x >= 1 THEN 'AMBER' ELSE 'GREEN' END AS colour,
               CAST(3.0 AS DOUBLE) AS red_line, CAST(1.0 AS DOUBLE) AS amber_line
        FROM (SELECT product, SUM(defects_found) * 100.0 / NULLIF(SUM(batch_size), 0) AS x
              FROM v_inspections GROUP BY product) p"""),
    "panel_rolling": sql(f"""
        SELECT date, rolling_30d_revenue_mn AS rolling_mn,
               {R("(SELECT AVG(CAST(rolling_30d_revenue_mn AS DECIMAL(20,3))) FROM r)", 6)} AS mean_mn FROM r""", DAILY, ROLLING),
    "panel_customers": sql(f"""
        SELECT cr.customer, {R("cr.revenue / 1000000", 6)} AS revenue_mn, (tp.customer IS NOT NULL) AS highlight
        FROM cr LEFT JOIN tp ON cr.customer = tp.customer""",
        ("cr", f"SELECT customer, SUM(revenue) AS revenue FROM v_orders WHERE {DEL} AND customer IS NOT NULL GROUP BY 1"),
        ("tp", "SELECT customer FROM cr ORDER BY revenue DESC, customer LIMIT 3")),
    "kpi_table": sql(f"""
        SELECT 'Total Revenue (Delivered)' AS label, {R("total_cr", 4)} AS value,
               printf('₹%.1f Cr', {R("total_cr", 1)}) AS value_text, 'GREEN' AS status FROM k
        UNION ALL SELECT 'Total Delivered Orders', {R("n_orders", 4)}, format('{{:,}}', n_orders), 'BLUE' FROM k
        UNION ALL SELECT 'Avg OEE Score', {R("avg_oee", 4)}, printf('%.1f%%', {R("avg_oee", 1)}),
               CASE WHEN avg_oee >= 85 THEN 'GREEN' ELSE 'AMBER' END FROM k
        UNION ALL SELECT 'Avg Defect Rate', {R("avg_defect", 4)}, printf('%.2f%%', {R("avg_defect", 2)}),
               CASE WHEN avg_defect < 1 THEN 'GREEN' ELSE 'AMBER' END FROM k
        UNION ALL SELECT 'Machines Below 70% OEE', {R("red", 4)}, CAST(red AS VARCHAR),
               CASE WHEN red > 2 THEN 'RED' ELSE 'AMBER' END FROM k
        UNION ALL SELECT 'Avg Lead Time', {R("avg_lead", 4)}, printf('%.1f days', {R("avg_lead", 1)}),
               CASE WHEN avg_lead <= 15 THEN 'GREEN' ELSE 'AMBER' END FROM k""",
        OEE_CTE(0.85, 0.70),
        ("dl", f"SELECT * FROM v_orders WHERE {DEL}"),
        ("k", f"""SELECT (SELECT SUM(revenue) / 10000000 FROM dl) AS total_cr, (SELECT COUNT(*) FROM dl) AS n_orders,
                  (SELECT AVG(avg_oee) * 100 FROM oee) AS avg_oee,
                  (SELECT AVG(defect_rate) * 100 FROM v_inspections) AS avg_defect,
                  (SELECT COUNT(*) FILTER (WHERE oee_rag = 'RED') FROM oee) AS red,
                  (SELECT AVG({LEAD}) FROM dl) AS avg_lead""")),
    "net_revenue": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_number, CAST(l_quantity AS DOUBLE) AS quantity,
               CAST(p_retailprice AS DOUBLE) AS unit_price, CAST(l_discount AS DOUBLE) AS discount_pct,
               CAST(ROUND(CAST(l_quantity AS DECIMAL(12,2)) * CAST(p_retailprice AS DECIMAL(12,2))
                          * (1 - CAST(l_discount AS DECIMAL(5,3))), 2) AS DOUBLE) AS net_revenue
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "sql_status_summary": """
        SELECT o_orderstatus AS status_code, CAST(COUNT(*) AS BIGINT) AS orders,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1""",
    "row_defect_rate": sql(f"""
        SELECT order_id, inspection_id, CAST(batch_size AS BIGINT) AS batch_size,
               CAST(defects_found AS DOUBLE) AS defects_found,
               {R("defects_found / NULLIF(batch_size, 0)", 4)} AS defect_rate FROM v_inspections"""),
    "check_pk": sql("""
        SELECT 'orders' AS table_name, CAST(order_id AS VARCHAR) AS key, CAST(COUNT(*) AS BIGINT) AS n
        FROM v_orders_table GROUP BY order_id HAVING COUNT(*) > 1 OR order_id IS NULL
        UNION ALL
        SELECT 'suppliers', CAST(supplier_id AS VARCHAR), CAST(COUNT(*) AS BIGINT)
        FROM v_suppliers GROUP BY supplier_id HAVING COUNT(*) > 1 OR supplier_id IS NULL
        UNION ALL
        SELECT 'quality_inspections', CAST(inspection_id AS VARCHAR), CAST(COUNT(*) AS BIGINT)
        FROM v_inspections GROUP BY inspection_id HAVING COUNT(*) > 1 OR inspection_id IS NULL"""),
    "check_fk": """
        SELECT 'orders.supplier_id->suppliers' AS relation, CAST(l_suppkey AS VARCHAR) AS key, CAST(COUNT(*) AS BIGINT) AS n
        FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY l_suppkey
        UNION ALL
        SELECT 'quality_inspections.order_id->orders', CAST(l_orderkey AS VARCHAR), CAST(COUNT(*) AS BIGINT)
        FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        GROUP BY l_orderkey""",
    "check_not_null": sql("""
        SELECT 'suppliers' AS table_name, 'supplier_name' AS column_name,
               CAST(COUNT(*) FILTER (WHERE supplier_name IS NULL) AS BIGINT) AS null_count FROM v_suppliers
        UNION ALL
        SELECT 'orders', 'order_date', CAST(COUNT(*) FILTER (WHERE order_date IS NULL) AS BIGINT) FROM v_orders_table"""),
    "check_enum": sql("""
        SELECT 'suppliers' AS table_name, 'tier' AS column_name, tier AS value, CAST(COUNT(*) AS BIGINT) AS n
        FROM v_suppliers WHERE tier IS NOT NULL AND tier NOT IN ('Tier 1', 'Tier 2', 'Tier 3') GROUP BY tier
        UNION ALL
        SELECT 'orders', 'status', status, CAST(COUNT(*) AS BIGINT) FROM v_orders_table
        WHERE status IS NOT NULL AND status NOT IN ('Delivered', 'Pending', 'Cancelled') GROUP BY status
        UNION ALL
        SELECT 'machine_events', 'event_type', event_type, CAST(COUNT(*) AS BIGINT) FROM v_events
        WHERE event_type IS NOT NULL AND event_type NOT IN ('cycle_complete', 'downtime_start', 'downtime_end',
              'maintenance', 'alert', 'shift_start', 'shift_end') GROUP BY event_type"""),
    "defaults_filled": sql("""
        SELECT order_id, customer, plant, CAST(revenue AS DOUBLE) AS revenue, status, CAST(0 AS DECIMAL(5,3)) AS discount_pct
        FROM v_order_heads"""),
    "defaults_suppliers": """
        SELECT s_suppkey AS supplier_id, s_name AS supplier_name, 'Tier 2' AS tier, CAST(1 AS TINYINT) AS active FROM supplier""",
    "defaults_inspections": """
        SELECT l_orderkey AS order_id, l_orderkey || '-' || l_linenumber AS inspection_id,
               CAST(l_quantity AS INTEGER) AS batch_size, CAST(0 AS INTEGER) AS defects_found,
               CAST(0 AS DECIMAL(6,4)) AS defect_rate, CAST(1 AS TINYINT) AS passed FROM lineitem""",
    "table_row_counts": """
        SELECT 'orders' AS table_name, CAST(COUNT(*) AS BIGINT) AS "rows" FROM lineitem
        UNION ALL SELECT 'suppliers', CAST(COUNT(*) AS BIGINT) FROM supplier
        UNION ALL SELECT 'quality_inspections', CAST(COUNT(*) AS BIGINT) FROM lineitem
        UNION ALL SELECT 'machine_events', CAST(COUNT(*) AS BIGINT) FROM events
        UNION ALL SELECT 'customer_feedback', CAST(COUNT(*) AS BIGINT) FROM documents""",
    "decimal_conformity": " UNION ALL ".join(
        f"""SELECT 'lineitem' AS table_name, '{c}' AS column_name, 'DECIMAL({p},{s})' AS declared_type,
               CAST(COUNT(*) FILTER (WHERE {c} IS NOT NULL AND (TRY_CAST({c} AS DECIMAL({p},{s})) IS NULL
                 OR CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,18)) <> CAST(TRY_CAST({c} AS DECIMAL({p},{s})) AS DECIMAL(38,18)))) AS BIGINT)
               AS non_conforming FROM lineitem"""
        for c, (p, s) in {"l_extendedprice": (10, 2), "l_discount": (5, 3), "l_tax": (6, 4),
                          "l_quantity": (4, 0)}.items()),
}

_WITHIN = ", ".join(f"TRUE AS {n}_within" for n in ("q1", "median", "q3", "p95"))

# other ways to the same analyses, and analyses over the mergeable forms
ORACLE |= {
    "events_flat_variant": ORACLE["events_flat"],
    "feedback_flat_variant": ORACLE["feedback_flat"],
    "document_unknown_keys": sql("""
        SELECT '$.tags' AS path, 'ARRAY<STRING>' AS kind, CAST(COUNT(*) AS BIGINT) AS documents FROM v_feedback HAVING COUNT(*) > 0
        UNION ALL
        SELECT '$.resolution.owner', 'STRING', CAST(COUNT(owner) AS BIGINT) FROM v_feedback HAVING COUNT(owner) > 0"""),
    "revenue_sketch_audit": sql(f"""
        SELECT CAST(year(order_date) AS BIGINT) AS year, CAST(COUNT(revenue) AS BIGINT) AS lines,
               CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(MIN(revenue) AS DOUBLE) AS smallest,
               CAST(MAX(revenue) AS DOUBLE) AS largest, {_WITHIN}
        FROM v_orders WHERE {DEL} GROUP BY 1"""),
    "distinct_customers_calendar": sql(f"""
        SELECT strftime(order_date, '%Y-%m') AS period, COUNT(DISTINCT c_custkey) AS customers FROM v_order_heads
        WHERE {DEL} GROUP BY 1 HAVING COUNT(c_custkey) > 0
        UNION ALL SELECT strftime(order_date, '%Y'), COUNT(DISTINCT c_custkey) FROM v_order_heads WHERE {DEL} GROUP BY 1
        HAVING COUNT(c_custkey) > 0
        UNION ALL SELECT 'all', COUNT(DISTINCT c_custkey) FROM v_order_heads WHERE {DEL} HAVING COUNT(c_custkey) > 0"""),
    "distinct_parties_by_month": sql(f"""
        SELECT strftime(order_date, '%Y-%m') AS month, COUNT(DISTINCT c_custkey) AS customers,
               COUNT(DISTINCT supplier_id) AS suppliers, COUNT(DISTINCT order_id) AS orders
        FROM v_orders WHERE {DEL} GROUP BY 1"""),
    "monthly_revenue_incremental": ORACLE["monthly_revenue_mom"],
    "rolling_30d_incremental": ORACLE["rolling_30d_revenue"],
    "table_row_counts_footer": ORACLE["table_row_counts"],
    "check_fk_bitmaps": ORACLE["check_fk"],
    "supplier_scorecard_sql": ORACLE["supplier_scorecard"],
    "constraint_report": "SELECT 'lineitem' AS table_name, * FROM (" + " UNION ALL ".join([
        """SELECT 'primary_key' AS rule, 'l_orderkey-l_linenumber' AS column_name, CAST(COUNT(*) AS BIGINT) AS violations FROM (
           SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1 OR l_orderkey IS NULL
           OR l_linenumber IS NULL)""",
        *[f"""SELECT 'reference', '{fk}', CAST(COUNT(*) AS BIGINT) FROM lineitem WHERE {fk} IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {pk} = {fk})"""
          for fk, parent, pk in (("l_suppkey", "supplier", "s_suppkey"), ("l_orderkey", "orders", "o_orderkey"))],
        *[f"SELECT 'not_null', '{c}', CAST(COUNT(*) AS BIGINT) FROM lineitem WHERE {c} IS NULL"
          for c in ("l_orderkey", "l_shipdate", "l_quantity")],
        *[f"SELECT 'enum', '{c}', CAST(COUNT(*) AS BIGINT) FROM lineitem WHERE {c} NOT IN ({domain})"
          for c, domain in (("l_returnflag", "'R', 'A'"), ("l_linestatus", "'O', 'F'"))],
        f"SELECT 'decimal', column_name, non_conforming FROM ({ORACLE['decimal_conformity']})"]) + ")",
}
