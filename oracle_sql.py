"""DuckDB oracle SQL for every ``queries()`` key (test material).

Written independently of the Spark code, as plain SQL over the driver's
pre-registered views.  Non-integer literals are cast to DOUBLE (a bare
``0.6`` is DECIMAL in DuckDB) and sums of integers are cast to BIGINT.
"""

from __future__ import annotations

# ---- shared CTEs -------------------------------------------------------------

PO = """
po_base AS (
  SELECT l.l_orderkey AS order_key,
         printf('ORD-%06d', l.l_orderkey) AS order_id,
         l.l_linenumber AS line_number,
         c.c_nationkey AS facility_id,
         p.p_type AS product_id,
         p.p_partkey AS part_id,
         p.p_brand AS category,
         p.p_type IN ('ECONOMY', 'SMALL', 'PROMO') AS critical_item,
         p.p_size >= 25 AS critical_part,
         l.l_suppkey AS supplier_id,
         CAST(0.75 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (l.l_suppkey % 5) AS supplier_reliability,
         1 + l.l_suppkey % 7 AS lead_days_planned,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(l.l_shipdate AS DATE) AS ship_date,
         CAST(floor(l.l_quantity) AS BIGINT) AS quantity_ordered,
         l.l_returnflag <> 'R' AS fulfilled,
         l.l_linestatus AS line_status,
         p.p_retailprice AS unit_cost
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
po AS (
  SELECT *,
         CASE WHEN fulfilled THEN quantity_ordered
              WHEN line_status = 'F' THEN CAST(floor(quantity_ordered * CAST(0.6 AS DOUBLE)) AS BIGINT)
              ELSE CAST(0 AS BIGINT) END AS quantity_received,
         CASE WHEN fulfilled AND (order_key + line_number) % 5 = 0 THEN 1 + order_key % 3
              WHEN fulfilled THEN CAST(0 AS BIGINT)
              WHEN line_status = 'F' THEN 2 + order_key % 6
              ELSE 5 + (order_key + line_number) % 16 END AS delay_days
  FROM po_base
)"""

PO_DATES = PO + """,
po_dates AS (
  SELECT *,
         order_date + CAST(lead_days_planned AS INTEGER) AS expected_delivery,
         order_date + CAST(lead_days_planned AS INTEGER) + CAST(delay_days AS INTEGER) AS actual_delivery,
         round(quantity_ordered * unit_cost, 2) AS unit_cost_total
  FROM po
)"""

FLOWS = PO + """,
events AS (
  SELECT facility_id, product_id, CAST(date_trunc('week', order_date) AS DATE) AS week,
         quantity_received AS received, CAST(0 AS BIGINT) AS consumption, CAST(1 AS BIGINT) AS n_orders
  FROM po
  UNION ALL
  SELECT facility_id, product_id, CAST(date_trunc('week', ship_date) AS DATE) AS week,
         CAST(0 AS BIGINT),
         CAST(floor(quantity_ordered * (78 + facility_id) / CAST(100.0 AS DOUBLE)) AS BIGINT),
         CAST(0 AS BIGINT)
  FROM po
),
flows AS (
  SELECT facility_id, product_id, week,
         CAST(sum(received) AS BIGINT) AS received,
         CAST(sum(consumption) AS BIGINT) AS consumption,
         CAST(sum(n_orders) AS BIGINT) AS n_orders
  FROM events GROUP BY ALL
),
bounds AS (SELECT min(week) AS w0, max(week) AS w1 FROM flows WHERE n_orders > 0),
entities AS (SELECT DISTINCT facility_id, product_id FROM flows),
calendar AS (
  SELECT CAST(unnest(generate_series(CAST(w0 AS TIMESTAMP), CAST(w1 AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week
  FROM bounds
),
dense AS (
  SELECT e.facility_id, e.product_id, c.week AS snapshot_date,
         coalesce(f.received, 0) AS received,
         coalesce(f.consumption, 0) AS consumption,
         coalesce(f.n_orders, 0) AS n_orders
  FROM entities e CROSS JOIN calendar c
  LEFT JOIN flows f ON f.facility_id = e.facility_id AND f.product_id = e.product_id AND f.week = c.week
)"""

INVENTORY = FLOWS + """,
inv_s AS (
  SELECT *,
         CAST(floor((2 + facility_id % 5) * avg(consumption) OVER (PARTITION BY facility_id, product_id)) AS BIGINT) AS open0,
         CAST(floor(2 * avg(consumption) OVER (PARTITION BY facility_id, product_id)) AS BIGINT) AS safety_stock
  FROM dense
),
inv_r AS (
  SELECT *, open0 + sum(received - consumption) OVER (PARTITION BY facility_id, product_id ORDER BY snapshot_date
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM inv_s
),
inv_c AS (
  SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY facility_id, product_id ORDER BY snapshot_date
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS closing_stock
  FROM inv_r
),
inventory AS (
  SELECT facility_id, product_id, snapshot_date,
         coalesce(lag(closing_stock) OVER (PARTITION BY facility_id, product_id ORDER BY snapshot_date), open0) AS opening_stock,
         received, consumption, closing_stock, safety_stock,
         CAST(closing_stock = 0 AS INTEGER) AS stockout,
         CAST(closing_stock < safety_stock AS INTEGER) AS below_safety,
         product_id IN ('ECONOMY', 'SMALL', 'PROMO') AS critical_item
  FROM inv_c
)"""



def r(expr: str, digits: int) -> str:
    """Half-up rounding, same form as the Spark side."""
    k = f"CAST(1e{digits} AS DOUBLE)"
    return f"(floor(({expr}) * {k} + CAST(0.5 AS DOUBLE)) / {k})"


W4 = "(PARTITION BY facility_id, product_id ORDER BY snapshot_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
WS = "(PARTITION BY facility_id, product_id ORDER BY snapshot_date)"

FEATURES = INVENTORY + f""",
feat AS (
  SELECT *,
         avg(consumption) OVER {W4} AS avg_consumption_4w,
         avg(received) OVER {W4} AS avg_received_4w,
         avg(stockout) OVER {W4} AS stockout_rate_4w,
         avg(below_safety) OVER {W4} AS below_safety_rate_4w
  FROM inventory
),
featd AS (
  SELECT *, least(CAST(60.0 AS DOUBLE),
                  closing_stock / CASE WHEN avg_consumption_4w = 0 THEN CAST(1.0 AS DOUBLE) ELSE avg_consumption_4w END)
            AS days_of_supply
  FROM feat
),
sstats AS (
  SELECT facility_id, product_id, CAST(date_trunc('week', order_date) AS DATE) AS snapshot_date,
         avg(supplier_reliability) AS avg_supplier_reliability,
         avg(delay_days) AS avg_delay_days,
         avg(CAST(fulfilled AS INTEGER)) AS fulfillment_rate
  FROM po GROUP BY ALL
),
mlds AS (
  SELECT f.facility_id, f.product_id, f.snapshot_date, f.opening_stock, f.received, f.consumption,
         f.closing_stock, f.safety_stock, f.stockout, f.below_safety, f.critical_item,
         f.avg_consumption_4w, f.avg_received_4w, f.stockout_rate_4w, f.below_safety_rate_4w, f.days_of_supply,
         CAST(greatest(coalesce(lead(f.stockout, 1) OVER (PARTITION BY f.facility_id, f.product_id ORDER BY f.snapshot_date), 0),
                       coalesce(lead(f.stockout, 2) OVER (PARTITION BY f.facility_id, f.product_id ORDER BY f.snapshot_date), 0))
              AS INTEGER) AS stockout_next_14d,
         s.avg_supplier_reliability, s.avg_delay_days, s.fulfillment_rate,
         CAST(weekofyear(f.snapshot_date) AS INTEGER) AS week_of_year,
         CAST(140 + 20 * n.n_nationkey AS BIGINT) AS facility_beds
  FROM featd f
  LEFT JOIN sstats s ON s.facility_id = f.facility_id AND s.product_id = f.product_id AND s.snapshot_date = f.snapshot_date
  LEFT JOIN nation n ON n.n_nationkey = f.facility_id
),
scored AS (
  SELECT *, floor(CAST(1e4 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + days_of_supply) + CAST(0.5 AS DOUBLE)) / CAST(1e4 AS DOUBLE) AS risk_score
  FROM mlds
),
test_split AS (SELECT * FROM scored WHERE snapshot_date >= DATE '2000-01-01'),
train_split AS (SELECT * FROM mlds WHERE snapshot_date < DATE '2000-01-01')"""


def level(s: str) -> str:
    return (f"CASE WHEN {s} > CAST(-0.001 AS DOUBLE) AND {s} <= CAST(0.25 AS DOUBLE) THEN 'Low' "
            f"WHEN {s} > CAST(0.25 AS DOUBLE) AND {s} <= CAST(0.55 AS DOUBLE) THEN 'Medium' "
            f"WHEN {s} > CAST(0.55 AS DOUBLE) AND {s} <= CAST(1.001 AS DOUBLE) THEN 'High' END")


_LAST = ["snapshot_date", "opening_stock", "received", "consumption", "closing_stock", "safety_stock",
         "stockout", "below_safety", "critical_item", "avg_consumption_4w", "avg_received_4w",
         "stockout_rate_4w", "below_safety_rate_4w", "days_of_supply", "stockout_next_14d",
         "avg_supplier_reliability", "avg_delay_days", "fulfillment_rate", "week_of_year", "facility_beds"]

CURRENT = FEATURES + """,
imputed AS (
  SELECT * REPLACE (
    coalesce(avg_supplier_reliability, (SELECT median(avg_supplier_reliability) FROM mlds)) AS avg_supplier_reliability,
    coalesce(avg_delay_days, (SELECT median(avg_delay_days) FROM mlds)) AS avg_delay_days,
    coalesce(fulfillment_rate, (SELECT median(fulfillment_rate) FROM mlds)) AS fulfillment_rate)
  FROM mlds
),
latest AS (
  SELECT facility_id, product_id, """ + ",\n         ".join(
    f"arg_max({c}, snapshot_date) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _LAST) + """
  FROM imputed GROUP BY facility_id, product_id
),
cur AS (
  SELECT * REPLACE (CAST(critical_item AS INTEGER) AS critical_item),
         floor(CAST(1e4 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + days_of_supply) + CAST(0.5 AS DOUBLE)) / CAST(1e4 AS DOUBLE) AS risk_score
  FROM latest
),
current AS (SELECT *, """ + level("risk_score") + """ AS risk_level FROM cur),
fac AS (
  SELECT n.n_nationkey AS facility_id, n.n_name AS facility_name, r.r_name AS region,
         CAST(140 + 20 * n.n_nationkey AS BIGINT) AS facility_beds
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
prod AS (
  SELECT DISTINCT p_type AS product_id, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS product_name,
         CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'SIZE' ELSE 'TIER' END AS category
  FROM part
)"""

# score table for the evaluation keys (test split)
SCORES = CURRENT + """,
st AS (
  SELECT risk_score AS score, CAST(sum(stockout_next_14d) AS BIGINT) AS pos,
         CAST(sum(1 - stockout_next_14d) AS BIGINT) AS neg
  FROM test_split GROUP BY risk_score
),
stc AS (
  SELECT *, CAST(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
            CAST(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
            row_number() OVER (ORDER BY score DESC) - 1 AS idx,
            (SELECT sum(pos) FROM st) AS P, (SELECT sum(neg) FROM st) AS N
  FROM st
)"""

K3 = "facility_id, product_id, snapshot_date"


def _with(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


SQL: dict[str, str] = {}

SQL["supplier_delays"] = _with(PO, """
SELECT d.supplier_id, d.delayed_orders,
       floor(d.avg_delay * 100 + CAST(0.5 AS DOUBLE)) / CAST(100.0 AS DOUBLE) AS avg_delay_days,
       d.max_delay_days,
       floor(d.fill * 1000 + CAST(0.5 AS DOUBLE)) / CAST(1000.0 AS DOUBLE) AS fulfillment_rate,
       s.s_name AS supplier_name
FROM (SELECT supplier_id, count(order_id) AS delayed_orders, avg(delay_days) AS avg_delay,
             max(delay_days) AS max_delay_days, avg(CAST(fulfilled AS INTEGER)) AS fill
      FROM po WHERE delay_days > 0 GROUP BY supplier_id) d
LEFT JOIN supplier s ON s.s_suppkey = d.supplier_id
ORDER BY d.avg_delay DESC, d.supplier_id""")

SQL["inv_flows"] = _with(FLOWS, """
SELECT facility_id, product_id, snapshot_date, received, consumption, n_orders FROM dense""")

SQL["inv_flows_all_weeks"] = _with(FLOWS.replace("FROM flows WHERE n_orders > 0", "FROM flows"), """
SELECT facility_id, product_id, snapshot_date, received, consumption, n_orders FROM dense""")

SQL["flow_reconciliation"] = _with(FLOWS, """
, t AS (
  SELECT 'received' AS flow, received AS v, week FROM flows UNION ALL SELECT 'consumption', consumption, week FROM flows)
SELECT flow, CAST(sum(v) AS BIGINT) AS total,
       CAST(sum(CASE WHEN week BETWEEN w0 AND w1 THEN v ELSE 0 END) AS BIGINT) AS inside,
       CAST(sum(CASE WHEN week BETWEEN w0 AND w1 THEN 0 ELSE v END) AS BIGINT) AS outside
FROM t, bounds GROUP BY flow""")

SQL["inv_rollforward"] = _with(INVENTORY, "SELECT * FROM inventory")

SQL["inv_rollforward_brand"] = _with(
    INVENTORY.replace("p.p_type AS product_id", "p.p_brand || '|' || p.p_type AS product_id")
             .replace("product_id IN ('ECONOMY', 'SMALL', 'PROMO') AS critical_item",
                      "split_part(product_id, '|', 2) IN ('ECONOMY', 'SMALL', 'PROMO') AS critical_item"),
    "SELECT * FROM inventory")


SQL["feat_rolling_4w"] = _with(FEATURES, f"""
SELECT {K3}, avg_consumption_4w, avg_received_4w, stockout_rate_4w, below_safety_rate_4w FROM featd""")

SQL["feat_days_of_supply"] = _with(FEATURES, f"""
SELECT {K3}, closing_stock, avg_consumption_4w, days_of_supply FROM featd""")

SQL["feat_lags"] = _with(FEATURES, f"""
SELECT {K3}, days_of_supply,
       lag(days_of_supply, 1) OVER {WS} AS dos_lag_1w,
       lag(days_of_supply, 2) OVER {WS} AS dos_lag_2w,
       lag(days_of_supply, 4) OVER {WS} AS dos_lag_4w,
       days_of_supply - lag(days_of_supply, 2) OVER {WS} AS dos_trend_2w
FROM featd""")

SQL["feat_dos_rolling"] = _with(FEATURES, f"""
SELECT {K3}, {r(f"avg(days_of_supply) OVER {W4}", 9)} AS dos_mean_4w,
       {r(f"stddev_samp(days_of_supply) OVER {W4}", 9)} AS dos_std_4w,
       CAST(sum(stockout) OVER {W4} AS BIGINT) AS stockout_count_4w
FROM featd""")

SQL["feat_calendar"] = _with(PO, """
SELECT order_id, line_number, order_date,
       CAST(weekofyear(order_date) AS INTEGER) AS week_of_year,
       CAST(month(order_date) AS INTEGER) AS month,
       CAST(quarter(order_date) = 4 AS INTEGER) AS q4_flag,
       CAST(date_trunc('week', order_date) AS DATE) AS order_week,
       CAST(date_trunc('month', order_date) AS DATE) AS order_month
FROM po""")

LOOKBACK = f""",
pod AS (SELECT *, order_date + CAST(lead_days_planned AS INTEGER) + CAST(delay_days AS INTEGER) AS delivered FROM po),
ordered AS (
  SELECT i.facility_id, i.product_id, i.snapshot_date, count(p.order_key) AS n,
         CAST(coalesce(sum(p.quantity_ordered), 0) AS BIGINT) AS units
  FROM inventory i LEFT JOIN pod p ON p.facility_id = i.facility_id AND p.product_id = i.product_id
   AND p.order_date >= i.snapshot_date - 28 AND p.order_date <= i.snapshot_date - 1
  GROUP BY ALL),
received_ AS (
  SELECT i.facility_id, i.product_id, i.snapshot_date,
         sum(p.quantity_received / p.quantity_ordered) / nullif(count(p.order_key), 0) AS fill,
         sum(p.delay_days) / nullif(count(p.order_key), 0) AS delay,
         sum(CASE WHEN p.delay_days >= 5 THEN 1 ELSE 0 END) / nullif(count(p.order_key), 0) AS severe
  FROM inventory i LEFT JOIN pod p ON p.facility_id = i.facility_id AND p.product_id = i.product_id
   AND p.delivered >= i.snapshot_date - 28 AND p.delivered <= i.snapshot_date - 1
  GROUP BY ALL),
lookback AS (
  SELECT o.facility_id, o.product_id, o.snapshot_date, o.n AS po_count_28d, o.units AS units_ordered_28d,
         {r("d.fill", 9)} AS avg_fill_rate_28d, d.delay AS avg_delay_28d, d.severe AS severe_share_28d
  FROM ordered o JOIN received_ d ON o.facility_id = d.facility_id AND o.product_id = d.product_id
   AND o.snapshot_date = d.snapshot_date)"""

SQL["feat_procurement_28d"] = _with(INVENTORY + LOOKBACK, "SELECT * FROM lookback")

SQL["ml_dataset_full"] = _with(FEATURES + LOOKBACK, f"""
SELECT f.facility_id, f.product_id, f.snapshot_date, f.closing_stock, f.days_of_supply,
       lag(f.days_of_supply, 1) OVER w AS dos_lag_1w, lag(f.days_of_supply, 2) OVER w AS dos_lag_2w,
       lag(f.days_of_supply, 4) OVER w AS dos_lag_4w,
       {r("avg(f.days_of_supply) OVER w4", 9)} AS dos_mean_4w,
       {r("stddev_samp(f.days_of_supply) OVER w4", 9)} AS dos_std_4w,
       f.days_of_supply - lag(f.days_of_supply, 2) OVER w AS dos_trend_2w,
       CAST(sum(f.stockout) OVER w4 AS BIGINT) AS stockout_count_4w,
       l.po_count_28d, l.units_ordered_28d, l.avg_fill_rate_28d, l.avg_delay_28d, l.severe_share_28d,
       CAST(month(f.snapshot_date) AS INTEGER) AS month, CAST(weekofyear(f.snapshot_date) AS INTEGER) AS week_of_year,
       CAST(quarter(f.snapshot_date) = 4 AS INTEGER) AS q4_flag,
       dense_rank() OVER (ORDER BY f.facility_id) - 1 AS facility_code,
       dense_rank() OVER (ORDER BY f.product_id) - 1 AS product_code, f.stockout_next_14d
FROM mlds f JOIN lookback l ON l.facility_id = f.facility_id AND l.product_id = f.product_id AND l.snapshot_date = f.snapshot_date
WINDOW w AS (PARTITION BY f.facility_id, f.product_id ORDER BY f.snapshot_date),
       w4 AS (PARTITION BY f.facility_id, f.product_id ORDER BY f.snapshot_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")

SQL["supplier_stats"] = _with(FEATURES, f"""
SELECT {K3}, {r("avg_supplier_reliability", 9)} AS avg_supplier_reliability, avg_delay_days, fulfillment_rate
FROM sstats""")

SQL["feat_supplier_join"] = _with(FEATURES, f"""
SELECT i.facility_id, i.product_id, i.snapshot_date, i.closing_stock,
       {r("s.avg_supplier_reliability", 9)} AS avg_supplier_reliability, s.avg_delay_days, s.fulfillment_rate
FROM inventory i LEFT JOIN sstats s
  ON s.facility_id = i.facility_id AND s.product_id = i.product_id AND s.snapshot_date = i.snapshot_date""")

SQL["enrich_dims"] = _with(CURRENT, """
SELECT p.order_id, p.line_number, p.facility_id, f.facility_name, f.region, f.facility_beds,
       p.product_id, d.product_name, p.category, p.critical_item, p.supplier_id, s.s_name AS supplier_name,
       p.supplier_reliability
FROM po p
LEFT JOIN fac f ON f.facility_id = p.facility_id
LEFT JOIN prod d ON d.product_id = p.product_id
LEFT JOIN supplier s ON s.s_suppkey = p.supplier_id""")

SQL["label_next_14d"] = _with(FEATURES, f"""
SELECT {K3}, stockout, stockout_next_14d FROM mlds""")

SQL["label_reorder_14d"] = _with(INVENTORY, f"""
SELECT {K3}, closing_stock, safety_stock, b AS below_reorder_30,
       CAST(greatest(coalesce(lead(b, 1) OVER {WS}, 0), coalesce(lead(b, 2) OVER {WS}, 0)) AS INTEGER) AS stockout_reorder_14d
FROM (SELECT *, CAST(closing_stock * 100 < 30 * safety_stock AS INTEGER) AS b FROM inventory)""")

SQL["distinct_dates"] = _with(PO, "SELECT DISTINCT order_date FROM po ORDER BY order_date")

SQL["risk_current"] = _with(CURRENT, f"""
SELECT facility_id, product_id, snapshot_date, closing_stock, stockout, critical_item, days_of_supply,
       stockout_rate_4w, {r("avg_supplier_reliability", 9)} AS avg_supplier_reliability, avg_delay_days,
       fulfillment_rate, facility_beds, week_of_year, risk_score, risk_level
FROM current""")

SQL["risk_level"] = _with(CURRENT, "SELECT facility_id, product_id, risk_score, risk_level FROM current")

SQL["facility_summary"] = _with(CURRENT, f"""
SELECT c.facility_id, c.high_risk_items, c.medium_risk_items, {r("c.m", 6)} AS mean_risk_score,
       c.critical_stockouts, c.critical_risk_items, f.facility_name, f.facility_beds
FROM (SELECT facility_id, count_if(risk_level = 'High') AS high_risk_items,
             count_if(risk_level = 'Medium') AS medium_risk_items, avg(risk_score) AS m,
             CAST(sum(CASE WHEN critical_item = 1 THEN stockout ELSE 0 END) AS BIGINT) AS critical_stockouts,
             count_if(risk_score > CAST(0.8 AS DOUBLE)) AS critical_risk_items
      FROM current GROUP BY facility_id) c
LEFT JOIN fac f ON f.facility_id = c.facility_id
ORDER BY c.m DESC, c.facility_id""")

SQL["risk_query"] = _with(CURRENT, f"""
SELECT facility_id, product_id, closing_stock, {r("days_of_supply", 1)} AS days_of_supply,
       {r("risk_score", 4)} AS risk_score, risk_level, critical_item, stockout_rate_4w, avg_delay_days
FROM current ORDER BY risk_score DESC, facility_id, product_id LIMIT 100""")

SQL["alerts"] = _with(CURRENT, f"""
SELECT (SELECT count(*) FROM current WHERE risk_level = 'High' AND critical_item = 1) AS total_alerts,
       c.facility_id, f.facility_name, c.product_id, d.product_name, {r("c.risk_score", 4)} AS risk_score,
       c.closing_stock, {r("c.days_of_supply", 1)} AS days_of_supply, c.avg_delay_days, c.stockout_rate_4w
FROM current c
LEFT JOIN fac f ON f.facility_id = c.facility_id
LEFT JOIN prod d ON d.product_id = c.product_id
WHERE c.risk_level = 'High' AND c.critical_item = 1
ORDER BY c.risk_score DESC, c.facility_id, c.product_id LIMIT 50""")

SQL["stat_strip"] = _with(CURRENT, f"""
SELECT count(*) AS items_monitored, count_if(critical_item = 1) AS critical_items,
       count_if(risk_level = 'High') AS high_risk_items,
       count_if(risk_score > CAST(0.8 AS DOUBLE)) AS critical_risk_items,
       {r("avg(risk_score)", 6)} AS mean_risk_score
FROM current""")

SQL["supplier_facility_alerts"] = _with(PO, f"""
SELECT supplier_id, facility_id, n_orders, on_time_orders, {r("rate", 4)} AS on_time_rate,
       {r("ad", 2)} AS avg_delay_days, severe_delays
FROM (SELECT supplier_id, facility_id, count(*) AS n_orders, count_if(delay_days = 0) AS on_time_orders,
             count_if(delay_days = 0) / count(*) AS rate, avg(delay_days) AS ad,
             count_if(delay_days >= 5) AS severe_delays
      FROM po GROUP BY supplier_id, facility_id)
WHERE rate < CAST(0.8 AS DOUBLE)""")

SQL["risk_search"] = _with(CURRENT, f"""
SELECT c.facility_id, c.product_id, d.product_name, d.category, {r("c.risk_score", 4)} AS risk_score, c.risk_level
FROM current c LEFT JOIN prod d ON d.product_id = c.product_id
WHERE d.category = 'SIZE' AND contains(lower(d.product_name), 'al')""")

BRAND_INVENTORY = (
    INVENTORY.replace("p.p_type AS product_id", "p.p_brand || '|' || p.p_type AS product_id")
             .replace("product_id IN ('ECONOMY', 'SMALL', 'PROMO') AS critical_item",
                      "split_part(product_id, '|', 2) IN ('ECONOMY', 'SMALL', 'PROMO') AS critical_item"))

SQL["category_stockout_rate"] = _with(BRAND_INVENTORY, f"""
, rate AS (
  SELECT b.category, sum(i.stockout) / count(i.stockout) AS rt
  FROM inventory i LEFT JOIN (SELECT DISTINCT product_id, category, critical_item FROM po) b
    ON b.product_id = i.product_id AND b.critical_item = i.critical_item
  GROUP BY b.category)
SELECT category, {r("rt", 6)} AS stockout_rate,
       CAST(rt > (SELECT median(rt) FROM rate) AS INTEGER) AS above_median
FROM rate""")

SQL["facility_risk_summary"] = _with(FEATURES, f"""
SELECT facility_id, {r("avg(stockout_next_14d)", 6)} AS actual_stockout_rate,
       {r("avg(risk_score)", 6)} AS predicted_risk_score, count(stockout_next_14d) AS n_samples
FROM test_split GROUP BY facility_id""")

SQL["split_temporal"] = _with(INVENTORY, f"""
SELECT {K3}, CASE WHEN snapshot_date < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split
FROM inventory""")

SQL["split_three_way"] = _with(INVENTORY, f"""
SELECT {K3}, CASE WHEN snapshot_date < DATE '1999-01-01' THEN 'train'
                  WHEN snapshot_date < DATE '2000-01-01' THEN 'validation' ELSE 'test' END AS split
FROM inventory""")

SQL["split_fractions"] = _with(INVENTORY, """
, per AS (SELECT snapshot_date AS d, count(*) AS n FROM inventory GROUP BY 1),
cum AS (SELECT d, sum(n) OVER (ORDER BY d) AS c, sum(n) OVER () AS t FROM per),
f AS (SELECT * FROM (VALUES ('0.5', 500), ('0.875', 875), ('0.995', 995), ('0.999', 999)) v(fraction, mille)),
cut AS (SELECT fraction, min(d) AS d FROM f, cum WHERE c * 1000 >= mille * t GROUP BY fraction)
SELECT fraction, count(*) AS train_rows, max(snapshot_date) AS last_train_date
FROM cut JOIN inventory ON snapshot_date < d GROUP BY fraction""")

SQL["split_80_20"] = _with(INVENTORY, """
, per AS (SELECT snapshot_date AS d, count(*) AS n FROM inventory GROUP BY 1),
cum AS (SELECT d, sum(n) OVER (ORDER BY d) AS c, sum(n) OVER () AS t FROM per),
cut AS (SELECT min(d) AS cutoff_date, CAST(any_value(t) AS BIGINT) AS total_rows FROM cum WHERE c * 100 >= 80 * t)
SELECT cutoff_date, total_rows, (SELECT count(*) FROM inventory WHERE snapshot_date < cutoff_date) AS train_rows
FROM cut""")

SQL["class_balance"] = _with(FEATURES, """
SELECT count_if(stockout_next_14d = 1) AS n_pos, count_if(stockout_next_14d = 0) AS n_neg,
       avg(stockout_next_14d) AS positive_rate,
       count_if(stockout_next_14d = 0) / nullif(count_if(stockout_next_14d = 1), 0) AS pos_weight
FROM train_split""")

SQL["class_weights"] = _with(FEATURES, f"""
SELECT {K3}, stockout_next_14d,
       CASE WHEN stockout_next_14d = 1
            THEN (SELECT count_if(stockout_next_14d = 0) / nullif(count_if(stockout_next_14d = 1), 0) FROM train_split)
            ELSE CAST(1.0 AS DOUBLE) END AS weight
FROM train_split""")

SQL["eval_confusion"] = _with(FEATURES, """
, c AS (SELECT stockout_next_14d AS a, CAST(risk_score >= CAST(0.3 AS DOUBLE) AS INTEGER) AS p FROM test_split),
cells AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted))
SELECT cells.actual, cells.predicted,
       (SELECT count(*) FROM c WHERE c.a = cells.actual AND c.p = cells.predicted) AS n
FROM cells""")

_REPORT = """
, c AS (
  SELECT count_if(y = 0 AND NOT pr) AS tn, count_if(y = 0 AND pr) AS fp,
         count_if(y = 1 AND NOT pr) AS fn, count_if(y = 1 AND pr) AS tp
  FROM (SELECT stockout_next_14d AS y, risk_score >= CAST(0.3 AS DOUBLE) AS pr FROM test_split)),
m AS (
  SELECT coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, tn + fp AS s0,
         coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, tp + fn AS s1,
         coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS acc, tp + tn + fp + fn AS n
  FROM c),
m2 AS (
  SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM m),
rows_ AS (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM m2
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM m2
  UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM m2
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m2
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM m2)
"""
SQL["eval_report"] = _with(FEATURES, _REPORT + f"""
SELECT class, {r("precision", 10)} AS precision, {r("recall", 10)} AS recall, {r("f1_score", 10)} AS f1_score, support
FROM rows_""")

SQL["eval_auc"] = _with(SCORES, """
SELECT CAST(sum(pos * (2 * (N - fp) + neg)) AS DOUBLE) / (CAST(2.0 AS DOUBLE) * any_value(P) * any_value(N)) AS roc_auc,
       CAST(any_value(P) AS BIGINT) AS positives, CAST(any_value(N) AS BIGINT) AS negatives
FROM stc""")

SQL["eval_average_precision"] = _with(SCORES, f"""
SELECT {r("sum(CAST(pos AS DOUBLE) / P * (tp / (tp + fp)))", 10)} AS average_precision FROM stc""")

SQL["eval_roc_points"] = _with(SCORES, """
, nb AS (
  SELECT *, lag(tp) OVER (ORDER BY idx) AS tp_prev, lag(fp) OVER (ORDER BY idx) AS fp_prev,
            lead(tp) OVER (ORDER BY idx) AS tp_next, lead(fp) OVER (ORDER BY idx) AS fp_next
  FROM stc)
SELECT fp / N AS fpr, tp / P AS tpr, score AS threshold FROM nb
WHERE tp_prev IS NULL OR tp_next IS NULL
   OR (fp_next - fp) <> (fp - fp_prev) OR (tp_next - tp) <> (tp - tp_prev)
UNION ALL
SELECT CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE)""")

SQL["eval_pr_points"] = _with(SCORES, """
SELECT tp / (tp + fp) AS precision, tp / P AS recall, score AS threshold
FROM stc WHERE idx <= (SELECT min(idx) FROM stc WHERE tp = P)
UNION ALL SELECT CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(NULL AS DOUBLE)""")

SQL["eval_tune_threshold"] = _with(
    SCORES.replace("FROM test_split GROUP BY risk_score",
                   "FROM scored WHERE snapshot_date >= DATE '1999-01-01' AND snapshot_date < DATE '2000-01-01' GROUP BY risk_score"), """
SELECT score AS threshold, tp, tp + fp AS predicted, CAST(P AS BIGINT) AS positives,
       tp / (tp + fp) AS precision, tp / P AS recall
FROM stc WHERE tp * 100 >= 60 * (tp + fp)
ORDER BY tp DESC, tp / (tp + fp) DESC, score DESC LIMIT 1""")

SQL["eval_cv_recall"] = _with(FEATURES, f"""
, per AS (
  SELECT (facility_id * 6 + length(product_id)) % 5 AS fold,
         count_if(stockout_next_14d = 1 AND risk_score >= CAST(0.3 AS DOUBLE))
           / nullif(count_if(stockout_next_14d = 1), 0) AS rc
  FROM scored GROUP BY 1)
SELECT {r("avg(rc)", 6)} AS mean_recall, {r("stddev_samp(rc)", 6)} AS std_recall, count(*) AS n_folds FROM per""")

SQL["impute_median"] = _with(FEATURES, f"""
SELECT {K3},
  {r("coalesce(avg_supplier_reliability, (SELECT median(avg_supplier_reliability) FROM mlds))", 9)} AS avg_supplier_reliability,
  coalesce(avg_delay_days, (SELECT median(avg_delay_days) FROM mlds)) AS avg_delay_days,
  coalesce(fulfillment_rate, (SELECT median(fulfillment_rate) FROM mlds)) AS fulfillment_rate
FROM mlds""")


SQL["label_censored"] = _with(FEATURES, f"""
SELECT {K3}, stockout_next_14d, next14 AS stockout_next_14_days
FROM (SELECT *, lead(stockout, 2) OVER {WS} IS NULL AS censored,
             coalesce(max(stockout) OVER (PARTITION BY facility_id, product_id ORDER BY snapshot_date
                      RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 14 DAY FOLLOWING), 0) AS next14
      FROM mlds)
WHERE NOT censored""")

SQL["src_csv_dates"] = _with(CURRENT + """,
pod AS (
  SELECT *, order_date + CAST(lead_days_planned AS INTEGER) AS expected_delivery,
         order_date + CAST(lead_days_planned AS INTEGER) + CAST(delay_days AS INTEGER) AS actual_delivery,
         round(quantity_ordered * unit_cost, 2) AS unit_cost_total FROM po)""", """
SELECT p.order_id, printf('F%03d', p.facility_id) AS facility_id, f.facility_name, f.region, f.facility_beds,
       p.product_id, d.product_name, p.category, p.critical_item, p.unit_cost,
       printf('S%03d', p.supplier_id) AS supplier_id, s.s_name AS supplier_name, p.supplier_reliability, p.order_date,
       p.expected_delivery, p.actual_delivery, p.quantity_ordered, p.quantity_received, p.lead_days_planned,
       p.delay_days, p.fulfilled, p.unit_cost_total
FROM pod p LEFT JOIN fac f ON f.facility_id = p.facility_id LEFT JOIN prod d ON d.product_id = p.product_id
LEFT JOIN supplier s ON s.s_suppkey = p.supplier_id""")

SQL["src_csv_inventory"] = _with(INVENTORY, """
SELECT * REPLACE (printf('F%03d', facility_id) AS facility_id) FROM inventory""")

SQL["src_csv_ml_dataset"] = _with(FEATURES, f"""
SELECT * REPLACE (printf('F%03d', facility_id) AS facility_id, {r("avg_supplier_reliability", 9)} AS avg_supplier_reliability)
FROM mlds""")

ORDERS_TEXT = """
t AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CAST(o_custkey AS VARCHAR) AS customer_key,
         o_totalprice AS price, o_orderstatus AS status,
         CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority END AS priority,
         CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(1 + o_orderkey % 14 AS VARCHAR) || '-'
           || CAST(day(o_orderdate) AS VARCHAR) AS order_date
  FROM orders
)"""

SQL["ingest_typed"] = _with(ORDERS_TEXT, """
SELECT TRY_CAST(order_key AS BIGINT) AS order_key, TRY_CAST(customer_key AS BIGINT) AS customer_key,
       status, priority, price AS total_price, CAST(try_strptime(order_date, '%Y-%m-%d') AS DATE) AS order_date,
       CAST(try_strptime(order_date, '%Y-%m-%d') IS NULL AS INTEGER) AS cast_errors
FROM t""")

SQL["validate_dates"] = _with(ORDERS_TEXT, """
SELECT 'order_date_parses' AS rule, count_if(try_strptime(order_date, '%Y-%m-%d') IS NULL) AS violations,
       count(*) AS checked
FROM t""")


def _profile(source: str, cols: list[str], rel: str) -> str:
    parts = [f"SELECT '{source}' AS source, '{c}' AS column_name, count(*) AS n_rows, "
             f"count_if({c} IS NULL) AS n_nulls FROM {rel}" for c in cols]
    return "\nUNION ALL\n".join(parts)


LINES = """
lines AS (
  SELECT l_orderkey AS order_key, printf('ORD-%06d', l_orderkey) AS order_id, l_linenumber AS line_number,
         l_partkey AS part_id, l_suppkey AS supplier_id,
         CAST(0.75 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (l_suppkey % 5) AS supplier_reliability,
         1 + l_suppkey % 7 AS lead_days_planned, CAST(l_shipdate AS DATE) AS ship_date,
         CAST(floor(l_quantity) AS BIGINT) AS quantity_ordered, l_returnflag <> 'R' AS fulfilled,
         l_linestatus AS line_status
  FROM lineitem),
outcome AS (
  SELECT *,
         CASE WHEN fulfilled THEN quantity_ordered
              WHEN line_status = 'F' THEN CAST(floor(quantity_ordered * CAST(0.6 AS DOUBLE)) AS BIGINT)
              ELSE CAST(0 AS BIGINT) END AS quantity_received,
         CASE WHEN fulfilled AND (order_key + line_number) % 5 = 0 THEN 1 + order_key % 3
              WHEN fulfilled THEN CAST(0 AS BIGINT)
              WHEN line_status = 'F' THEN 2 + order_key % 6
              ELSE 5 + (order_key + line_number) % 16 END AS delay_days
  FROM lines),
raw_feed AS (
  SELECT * REPLACE (
    CASE WHEN (order_key * 7 + line_number) % 97 = 0 THEN 0
         WHEN (order_key * 7 + line_number) % 101 = 0 THEN NULL ELSE quantity_ordered END AS quantity_ordered,
    CASE WHEN (order_key * 7 + line_number) % 83 = 0 THEN quantity_ordered + 1
         WHEN (order_key * 7 + line_number) % 89 = 0 THEN -1 ELSE quantity_received END AS quantity_received,
    CASE WHEN (order_key * 7 + line_number) % 79 = 0 THEN -1 ELSE delay_days END AS delay_days)
  FROM outcome),
deliveries AS (
  SELECT o.order_id, o.line_number, o.supplier_id,
         CAST(h.o_orderdate AS DATE) + CAST(o.lead_days_planned AS INTEGER) AS expected_delivery,
         CASE WHEN o.quantity_received > 0 THEN CAST(h.o_orderdate AS DATE) END AS actual_delivery,
         CASE WHEN o.quantity_received > 0 THEN o.quantity_received END AS quantity_received, o.delay_days, o.fulfilled
  FROM outcome o JOIN orders h ON h.o_orderkey = o.order_key)"""

SQL["ingest_profile"] = _with(FEATURES + "," + LINES, "\nUNION ALL\n".join([
    _profile("procurement", ["order_key", "order_id", "line_number", "part_id", "supplier_id", "supplier_reliability",
                             "lead_days_planned", "ship_date", "quantity_ordered", "quantity_received", "delay_days",
                             "fulfilled", "line_status"], "raw_feed"),
    _profile("deliveries", ["order_id", "line_number", "supplier_id", "expected_delivery", "actual_delivery",
                            "quantity_received", "delay_days", "fulfilled"], "deliveries"),
    _profile("inventory", ["facility_id", "product_id", *_LAST], "mlds")]))

SQL["validate_rules"] = _with(LINES, """
SELECT 'quantity_ordered_positive' AS rule, count_if(NOT coalesce(quantity_ordered > 0, false)) AS violations,
       count(*) AS checked FROM raw_feed
UNION ALL SELECT 'quantity_received_non_negative', count_if(NOT coalesce(quantity_received >= 0, false)), count(*) FROM raw_feed
UNION ALL SELECT 'fill_rate_in_unit_interval',
       count_if(NOT coalesce(quantity_received / nullif(quantity_ordered, 0) BETWEEN 0 AND 1, false)), count(*) FROM raw_feed
UNION ALL SELECT 'delay_days_non_negative', count_if(NOT coalesce(delay_days >= 0, false)), count(*) FROM raw_feed""")


def _ri(child: str, ck: str, parent: str, pk: str, rule: str) -> str:
    return (f"SELECT '{rule}' AS rule, count(*) AS violations, (SELECT count(*) FROM {child}) AS checked, "
            f"min(CAST(c.{ck} AS VARCHAR)) AS example_key "
            f"FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{ck})")


SQL["validate_ri"] = "\nUNION ALL\n".join([
    _ri("lineitem", "l_orderkey", "orders", "o_orderkey", "lineitem.l_orderkey -> orders"),
    _ri("orders", "o_custkey", "customer", "c_custkey", "orders.o_custkey -> customer"),
    _ri("lineitem", "l_partkey", "part", "p_partkey", "lineitem.l_partkey -> part"),
    _ri("lineitem", "l_suppkey", "supplier", "s_suppkey", "lineitem.l_suppkey -> supplier"),
    _ri("documents", "doc_id", "labels", "doc_id", "documents.doc_id -> labels"),
])

SQL["validate_ri_orphans"] = """
SELECT d.doc_id, d.lang, d.source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""

SQL["star_dims"] = _with(CURRENT, """
SELECT DISTINCT 'dim_facility' AS table_name, CAST(f.facility_id AS VARCHAR) AS member_key, f.facility_name AS label
FROM fac f WHERE f.facility_id IN (SELECT facility_id FROM po)
UNION ALL
SELECT 'dim_product', d.product_id, d.product_name FROM prod d WHERE d.product_id IN (SELECT product_id FROM po)
UNION ALL
SELECT 'dim_supplier', CAST(s.s_suppkey AS VARCHAR), s.s_name FROM supplier s
WHERE s.s_suppkey IN (SELECT supplier_id FROM po)
UNION ALL
SELECT 'dim_date', CAST(year(order_date) * 10000 + month(order_date) * 100 + day(order_date) AS VARCHAR),
       strftime(order_date, '%Y-%m-%d')
FROM (SELECT DISTINCT order_date FROM po)""")

SQL["star_fact_po"] = _with(PO_DATES, """
SELECT order_id, line_number, facility_id, product_id, supplier_id,
       CAST(year(order_date) * 10000 + month(order_date) * 100 + day(order_date) AS INTEGER) AS date_key,
       quantity_ordered, unit_cost_total, CAST(date_trunc('month', order_date) AS DATE) AS order_month
FROM po_dates""")

_DELIVERY = """order_id, line_number, facility_id, product_id, supplier_id,
       CAST(year(expected_delivery) * 10000 + month(expected_delivery) * 100 + day(expected_delivery) AS INTEGER) AS expected_date_key,
       CAST(year(actual_delivery) * 10000 + month(actual_delivery) * 100 + day(actual_delivery) AS INTEGER) AS actual_date_key,
       quantity_received, delay_days, fulfilled, CAST(date_trunc('month', order_date) AS DATE) AS order_month"""

SQL["star_fact_delivery"] = _with(PO_DATES, f"SELECT {_DELIVERY} FROM po_dates")

# an order repeats line numbers in the test tables, so the join is between tables, not rows
SQL["join_po_delivery"] = _with(PO_DATES, f"""
SELECT p.order_id, p.line_number, p.facility_id, p.product_id, p.supplier_id,
       CAST(year(p.order_date) * 10000 + month(p.order_date) * 100 + day(p.order_date) AS INTEGER) AS date_key,
       p.quantity_ordered, p.unit_cost_total, CAST(date_trunc('month', p.order_date) AS DATE) AS order_month,
       d.expected_date_key, d.actual_date_key, d.quantity_received, d.delay_days, d.fulfilled
FROM po_dates p JOIN (SELECT {_DELIVERY} FROM po_dates) d ON d.order_id = p.order_id AND d.line_number = p.line_number""")

SQL["star_fact_inventory"] = _with(INVENTORY, """
SELECT *, CAST(date_trunc('month', snapshot_date) AS DATE) AS snapshot_month FROM inventory""")

SQL["star_tables"] = _with(INVENTORY, """
SELECT 'dim_facility' AS table_name, (SELECT count(DISTINCT facility_id) FROM po) AS n_rows
UNION ALL SELECT 'dim_product', (SELECT count(DISTINCT product_id) FROM po)
UNION ALL SELECT 'dim_supplier', (SELECT count(DISTINCT supplier_id) FROM po)
UNION ALL SELECT 'dim_date', (SELECT count(DISTINCT order_date) FROM po)
UNION ALL SELECT 'fact_procurement', (SELECT count(*) FROM po)
UNION ALL SELECT 'fact_delivery', (SELECT count(*) FROM po)
UNION ALL SELECT 'fact_inventory', (SELECT count(*) FROM inventory)""")

_MEMBERS = _with(PO, """
SELECT 'facilities' AS dimension, CAST(n.n_nationkey AS VARCHAR) AS member_key,
       n.n_name || '|' || (140 + 20 * n.n_nationkey) || '|' || r.r_name AS attributes
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT 'suppliers', CAST(s_suppkey AS VARCHAR),
       s_name || '|' || printf('%.6f', CAST(0.75 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (s_suppkey % 5))
       || '|' || printf('%.6f', CAST(1 + s_suppkey % 7 AS DOUBLE)) FROM supplier
UNION ALL
SELECT 'products', p_type, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || '|'
       || CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'SIZE' ELSE 'TIER' END || '|'
       || printf('%.6f', avg(p_retailprice)) || '|'
       || CAST(p_type IN ('ECONOMY', 'SMALL', 'PROMO') AS VARCHAR) FROM part GROUP BY p_type
UNION ALL
SELECT 'date_range', 'range', strftime(min(order_date), '%Y-%m-%d') || '|' || strftime(max(order_date), '%Y-%m-%d') FROM po""")
SQL["sink_json_metadata"] = _MEMBERS
SQL["src_json_dims"] = _MEMBERS

SQL["encode_rows"] = _with(INVENTORY, f"""
SELECT {K3}, dense_rank() OVER (ORDER BY facility_id) - 1 AS facility_id_enc,
       dense_rank() OVER (ORDER BY product_id) - 1 AS product_id_enc FROM inventory""")

SQL["scores_export"] = _with(CURRENT, """
SELECT facility_id, product_id, snapshot_date, risk_score, risk_level FROM current""")

SQL["ml_batch_score"] = _with(CURRENT, """
SELECT facility_id, product_id, snapshot_date, true AS score_in_range, true AS level_fits_score FROM current""")

SQL["ml_scores_export"] = _with(CURRENT, """
SELECT facility_id, product_id, snapshot_date, true AS same_score, true AS level_fits_score FROM current""")

SQL["ml_top_feature"] = _with(FEATURES, "SELECT count(*) AS test_rows, true AS auc_falls FROM test_split")

_FEATURE_NAMES = ["closing_stock", "days_of_supply", "avg_consumption_4w", "avg_received_4w", "stockout_rate_4w",
                  "below_safety_rate_4w", "avg_supplier_reliability", "avg_delay_days", "fulfillment_rate",
                  "facility_beds", "week_of_year", "critical_item"]

SQL["ml_importances"] = "SELECT feature, true AS is_share, CAST(1.0 AS DOUBLE) AS total FROM (VALUES " + ", ".join(
    f"('{f}')" for f in _FEATURE_NAMES) + ") v(feature)"

SQL["ml_metrics_roundtrip"] = _with(FEATURES, f"""
SELECT (SELECT count(*) FROM train_split) AS train_samples, count(*) AS test_samples,
       round(avg(stockout_next_14d), 4) AS test_positive_rate, '2000-01-01' AS test_cutoff,
       CAST(0.3 AS DOUBLE) AS decision_threshold, '{",".join(_FEATURE_NAMES)}' AS features,
       count(*) AS confusion_total, CAST(sum(stockout_next_14d) AS BIGINT) AS confusion_positives,
       true AS recall_fits, true AS precision_fits, true AS accuracy_fits, true AS auc_above_0_9
FROM test_split""")

SQL["ml_cv_recall"] = _with(FEATURES, """,
folds AS (SELECT (facility_id * 6 + length(product_id)) % 5 AS fold, stockout_next_14d FROM mlds)
SELECT CAST(fold AS INTEGER) AS fold, (SELECT count(*) FROM folds) - count(*) AS train_rows, count(*) AS test_rows,
       CAST(sum(stockout_next_14d) AS BIGINT) AS positives, CAST(count(*) - sum(stockout_next_14d) AS BIGINT) AS negatives,
       true AS recall_fits, true AS recall_above_half, true AS better_than_chance
FROM folds GROUP BY fold""")

SQL["json_records"] = _with(CURRENT, f"""
SELECT facility_id, product_id, closing_stock, {r("days_of_supply", 1)} AS days_of_supply,
       {r("risk_score", 4)} AS risk_score, risk_level, critical_item, stockout_rate_4w, avg_delay_days, 9 AS n_fields
FROM current ORDER BY current.risk_score DESC, facility_id, product_id LIMIT 100""")

SQL["json_alerts"] = _with(CURRENT, f"""
SELECT (SELECT count(*) FROM current WHERE risk_level = 'High' AND critical_item = 1) AS total_alerts,
       row_number() OVER (ORDER BY c.risk_score DESC, c.facility_id, c.product_id) AS place,
       c.facility_id, f.facility_name, c.product_id, d.product_name, {r("c.risk_score", 4)} AS risk_score,
       c.closing_stock, {r("c.days_of_supply", 1)} AS days_of_supply, c.avg_delay_days, c.stockout_rate_4w
FROM current c
LEFT JOIN fac f ON f.facility_id = c.facility_id
LEFT JOIN prod d ON d.product_id = c.product_id
WHERE c.risk_level = 'High' AND c.critical_item = 1
QUALIFY place <= 50""")


SQL["encode_labels"] = _with(INVENTORY, """
SELECT 'facility_id' AS column_name, CAST(facility_id AS VARCHAR) AS value,
       dense_rank() OVER (ORDER BY facility_id) - 1 AS code
FROM (SELECT DISTINCT facility_id FROM inventory)
UNION ALL
SELECT 'product_id', product_id, dense_rank() OVER (ORDER BY product_id) - 1
FROM (SELECT DISTINCT product_id FROM inventory)""")


SEASON = "(CAST(1.0 AS DOUBLE) + CAST(0.25 AS DOUBLE) * cos(CAST(2.0 * pi() AS DOUBLE) * (dayofyear({d}) - 355) / CAST(365.0 AS DOUBLE)))"

SQL["proj_seasonal"] = _with(PO, f"""
SELECT order_date, CAST(dayofyear(order_date) AS INTEGER) AS day_of_year,
       {r(SEASON.format(d="order_date"), 12)} AS seasonal_multiplier
FROM (SELECT DISTINCT order_date FROM po)""")

SQL["proj_line_cost"] = _with(PO_DATES, """
SELECT order_id, line_number, quantity_ordered, unit_cost, unit_cost_total FROM po_dates""")

SQL["proj_delivery_dates"] = _with(PO_DATES, """
SELECT order_id, line_number, order_date, lead_days_planned, delay_days, expected_delivery, actual_delivery,
       strftime(expected_delivery, '%Y-%m-%d') AS expected_text, strftime(actual_delivery, '%Y-%m-%d') AS actual_text
FROM po_dates""")

SQL["proj_order_id"] = _with(PO, "SELECT DISTINCT order_key, order_id FROM po")

SQL["proj_partial_receipt"] = _with(PO, """
SELECT order_id, line_number, line_status, fulfilled, quantity_ordered, quantity_received, delay_days FROM po""")

SQL["proj_safety_stock"] = _with(PO, f"""
SELECT w.facility_id, w.week,
       {r("(140 + 20 * w.facility_id) / CAST(300.0 AS DOUBLE)", 12)} AS facility_scale,
       {r("(140 + 20 * w.facility_id) / CAST(300.0 AS DOUBLE) * " + SEASON.format(d="w.week"), 12)} AS demand_index,
       CAST(floor((140 + 20 * w.facility_id) / CAST(300.0 AS DOUBLE) * CAST(60.0 AS DOUBLE)) AS BIGINT) AS safety_stock
FROM (SELECT DISTINCT facility_id, CAST(date_trunc('week', order_date) AS DATE) AS week FROM po) w
JOIN nation n ON n.n_nationkey = w.facility_id""")

SQL["proj_delay_severity"] = _with(PO, """
SELECT order_id, line_number, delay_days, CAST(delay_days >= 5 AS INTEGER) AS delay_severe,
       CASE WHEN delay_days <= 0 THEN 'on_time' WHEN delay_days < 5 THEN 'late' ELSE 'severe' END AS delay_band
FROM po""")

SQL["proj_coverage_bucket"] = _with(FEATURES, f"""
SELECT {K3}, days_of_supply,
       CASE WHEN days_of_supply < 1 THEN 'lt_1w' WHEN days_of_supply < 2 THEN '1_2w'
            WHEN days_of_supply < 4 THEN '2_4w' WHEN days_of_supply IS NOT NULL THEN 'ge_4w' END AS coverage_bucket
FROM featd""")

SQL["risk_query_filtered"] = _with(CURRENT, f"""
SELECT facility_id, product_id, closing_stock, {r("days_of_supply", 1)} AS days_of_supply,
       {r("risk_score", 4)} AS risk_score, risk_level, critical_item, stockout_rate_4w, avg_delay_days
FROM current WHERE facility_id = 3 AND risk_level = 'Low' AND critical_item = 1
ORDER BY risk_score DESC, facility_id, product_id LIMIT 100""")


# the long-series form must give the rows of the plain one
for _key in ("inv_rollforward", "inv_rollforward_brand", "feat_rolling_4w", "feat_lags", "feat_dos_rolling", "label_next_14d"):
    SQL[f"{_key}_blocks"] = SQL[_key]


SQL["join_po_delivery_bucketed"] = SQL["join_po_delivery"]

_CORRECTED = PO_DATES + """,
corrected AS (
  SELECT * REPLACE (CASE WHEN order_key % 10 = 0 THEN CAST(0 AS BIGINT) ELSE quantity_received END AS quantity_received,
                    fulfilled AND order_key % 10 <> 0 AS fulfilled,
                    CASE WHEN order_key % 50 = 0 THEN CAST(order_date + INTERVAL 1 MONTH AS DATE) ELSE order_date END AS order_date),
         CASE WHEN order_key % 10 = 0 THEN 2 ELSE 1 END AS version
  FROM po_dates
)"""

SQL["star_incremental"] = _with(_CORRECTED, f"SELECT {_DELIVERY}, CAST(version AS INTEGER) AS version FROM corrected")

SQL["star_incremental_tables"] = _with(_CORRECTED, """
SELECT 'dim_facility' AS table_name, (SELECT count(DISTINCT facility_id) FROM po) AS n_rows
UNION ALL SELECT 'dim_product', (SELECT count(DISTINCT product_id) FROM po)
UNION ALL SELECT 'dim_supplier', (SELECT count(DISTINCT supplier_id) FROM po)
UNION ALL SELECT 'dim_date', (SELECT count(*) FROM (SELECT order_date FROM po UNION SELECT order_date FROM corrected))
UNION ALL SELECT 'fact_procurement', (SELECT count(*) FROM po)
UNION ALL SELECT 'fact_delivery', (SELECT count(*) FROM po)""")

SQL["risk_current_incremental"] = SQL["risk_current"].replace("FROM imputed GROUP BY", "FROM mlds GROUP BY")

SQL["risk_search_index"] = SQL["risk_search"]

SQL["part_search_index"] = """
SELECT t.text, p.p_partkey AS part_id, p.name
FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS name FROM part) p
JOIN (VALUES ('Bolt brand#1'), ('RING'), ('zzz'), ('le')) t(text) ON contains(lower(p.name), lower(t.text))"""

_CODES = """codes AS (
  SELECT value, old, CASE WHEN old THEN 0 ELSE (SELECT count(*) FROM v WHERE old) END
                + row_number() OVER (PARTITION BY old ORDER BY value) - 1 AS code
  FROM v
)"""
_CODES = """v AS (
  SELECT p_brand || '|' || p_type AS value, bool_or(p_partkey % 3 = 0 AND p_partkey < 600) AS old FROM part GROUP BY 1
),
""" + _CODES

SQL["dictionary_codes"] = _with(_CODES, "SELECT value, CAST(code AS BIGINT) AS code FROM codes")

SQL["dictionary_rows"] = _with(_CODES, """
SELECT p.p_partkey, c.value AS product_id, CAST(CASE WHEN c.old THEN c.code ELSE -1 END AS BIGINT) AS code_then,
       CAST(c.code AS BIGINT) AS code
FROM part p JOIN codes c ON c.value = p.p_brand || '|' || p.p_type""")

SQL["median_sketches"] = _with(FEATURES, "\nUNION ALL\n".join(f"""
SELECT CAST(year(snapshot_date) AS INTEGER) AS year, '{c}' AS column_name, count({c}) AS n, count({c}) AS n_rows, true AS within_bound
FROM mlds GROUP BY 1""" for c in ("avg_supplier_reliability", "avg_delay_days", "fulfillment_rate")))

_LINES = ORDERS_TEXT + """,
l AS (
  SELECT CAST(order_key AS BIGINT) AS k, customer_key, status, order_date, priority,
         CAST(order_key AS BIGINT) % 41 = 0 AS malformed, CAST(try_strptime(order_date, '%Y-%m-%d') AS DATE) AS parsed,
         order_key || ',' || customer_key || ',' || status || ',' || CASE WHEN CAST(order_key AS BIGINT) % 41 = 0 THEN '' ELSE '1.5,' END
           || order_date || ',' || coalesce(priority, '') AS raw_line
  FROM t
)"""

SQL["ingest_quarantine"] = _with(_LINES, """
SELECT k AS order_key, raw_line,
       CASE WHEN malformed THEN 'malformed line'
            ELSE concat_ws('; ', CASE WHEN parsed IS NULL THEN 'order_date: not a date' END,
                           CASE WHEN priority IS NULL THEN 'priority is given' END) END AS reasons
FROM l WHERE malformed OR parsed IS NULL OR priority IS NULL""")

SQL["ingest_quarantine_clean"] = _with(_LINES, """
SELECT k AS order_key, CAST(customer_key AS BIGINT) AS customer_key, status, CAST(1.5 AS DOUBLE) AS total_price,
       parsed AS order_date, priority
FROM l WHERE NOT malformed AND parsed IS NOT NULL AND priority IS NOT NULL""")


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if is HUGEINT; wrap every call in a BIGINT cast."""
    out, i, tag = [], 0, "count_if("
    while True:
        j = sql.find(tag, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tag)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


def oracle_sql() -> dict[str, str]:
    return {k: _bigint_count_if(v) for k, v in SQL.items()}
