"""SQL that states the result of each query on the test tables, in DuckDB's dialect.

Money is kept in whole cents and rounded half to even in integers, so no rounding of doubles is compared.
"""

from __future__ import annotations


def half_even(x: str, d: int | str) -> str:
    """SQL for x/d, rounded half to even, of whole numbers x >= 0 and d > 0."""
    return (
        f"((({x}) // ({d})) + CASE WHEN 2 * (({x}) % ({d})) > ({d})"
        f" OR (2 * (({x}) % ({d})) = ({d}) AND (({x}) // ({d})) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def clip(x: str, low: int, high: int) -> str:
    return f"greatest({low}, least({high}, {x}))"


FACTS = f"""
WITH raw AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS part_key,
    l_suppkey AS supplier_key,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS price_c,
    CAST(round(l_discount * 100) AS BIGINT) AS disc,
    CAST(round(l_tax * 100) AS BIGINT) AS tax,
    CAST(1 + CAST(l_quantity AS INTEGER) % 5 AS INTEGER) AS review_score,
    o_custkey AS customer_id, o_orderdate AS order_date,
    CASE WHEN o_orderstatus = 'P' AND l_returnflag = 'R' THEN 'cancelled'
      WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped'
      WHEN o_orderstatus = 'P' THEN 'processing' END AS order_status,
    p_type AS category,
    CASE p_type WHEN 'ECONOMY' THEN 68 WHEN 'LARGE' THEN 55 WHEN 'MEDIUM' THEN 57
      WHEN 'PROMO' THEN 43 WHEN 'SMALL' THEN 35 WHEN 'STANDARD' THEN 60 END AS cost_pct,
    n_name AS city, r_name AS gender, c_mktsegment AS device,
    CASE WHEN c_acctbal > 7800 THEN '55+' WHEN c_acctbal > 5600 THEN '45-54'
      WHEN c_acctbal > 3400 THEN '35-44' WHEN c_acctbal > 1200 THEN '25-34'
      WHEN c_acctbal IS NOT NULL THEN '18-24' END AS age_group
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN part ON l_partkey = p_partkey
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
), charged AS (
  SELECT *, {half_even("price_c * cost_pct", 100)} AS cogs_c,
    {clip(half_even("price_c * 6", 10000), 30, 400)} AS delivery_cost,
    {clip(half_even("price_c * (5 + tax)", 10000), 40, 500)} AS delivery_charge,
    {half_even("price_c * disc", 10000)} AS discount
  FROM raw
), paid AS (
  SELECT *, {half_even("price_c - 100 * discount + 100 * delivery_charge", 100)} AS payment FROM charged
), facts AS (
  SELECT *, 100 * payment - cogs_c - 100 * delivery_cost AS profit_c,
    order_status IS DISTINCT FROM 'cancelled' AS kept,
    strftime(order_date, '%Y-%m') AS month, strftime(order_date, '%b %Y') AS month_name,
    CAST(isodow(order_date) - 1 AS INTEGER) AS weekday, dayname(order_date) AS day_of_week
  FROM paid
)"""

EVENTS = """
WITH facts AS (
  SELECT user_id AS customer_id, event_type AS category, CAST(hour(ts) AS INTEGER) AS hour,
    CAST(isodow(ts) - 1 AS INTEGER) AS weekday, dayname(ts) AS day_of_week
  FROM events
)"""

N = "CAST(count(*) AS BIGINT)"
REVENUE = "CAST(coalesce(sum(payment), 0) AS DOUBLE)"
PROFIT = "(CAST(coalesce(sum(profit_c), 0) AS DOUBLE) / 100)"
COGS = "(CAST(coalesce(sum(cogs_c), 0) AS DOUBLE) / 100)"
AVG_PAID = "CAST(sum(payment) AS DOUBLE) / count(payment)"
AVG_PRICE = "(CAST(sum(price_c) AS DOUBLE) / 100) / count(price_c)"
AVG_RATING = "CAST(sum(review_score) AS DOUBLE) / count(review_score)"
AVG_DISCOUNT = "CAST(sum(disc) AS DOUBLE) / count(disc)"
CANCEL_RATE = "count(*) FILTER (WHERE NOT kept) * CAST(100 AS DOUBLE) / count(*)"


def grouped(keys: str, *measures: str, where: str = "true", base: str = FACTS) -> str:
    return f"{base} SELECT {', '.join([keys, *measures])} FROM facts WHERE {where} GROUP BY {keys}"


def mode_of(source: str, key: str, value: str) -> str:
    """Subquery (key, value): the most frequent value per key, the smallest on ties."""
    return f"""(SELECT {key}, {value} FROM (
      SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS place
      FROM {source} WHERE {value} IS NOT NULL GROUP BY {key}, {value}) WHERE place = 1)"""


_SEQUENCE = "order_key, line_number, part_key, supplier_key, price_c"
_DOWN = ", ".join(f"{c} DESC" for c in _SEQUENCE.split(", "))

RFM = f"""{FACTS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {_SEQUENCE}) AS from_first,
    row_number() OVER (PARTITION BY customer_id ORDER BY {_DOWN}) AS from_last
  FROM facts WHERE kept
), rfm AS (
  SELECT customer_id,
    CAST(date_sub('day', max(order_date), (SELECT max(order_date) + INTERVAL 1 DAY FROM facts)) AS INTEGER)
      AS recency,
    CAST(count(order_date) AS BIGINT) AS frequency, {REVENUE} AS monetary, {AVG_RATING} AS avg_rating,
    max(city) FILTER (WHERE from_first = 1) AS city, max(gender) FILTER (WHERE from_first = 1) AS gender,
    max(age_group) FILTER (WHERE from_first = 1) AS age_group,
    max(device) FILTER (WHERE from_first = 1) AS device,
    max(category) FILTER (WHERE from_last = 1) AS last_category
  FROM placed GROUP BY customer_id
)"""


def edge_sql(q: int, k: int, part: str) -> str:
    """Order statistic below (lo) or above (hi) the k-th q-quantile of the ``ordered`` rows."""
    position = f"((n - 1) * {k}) // {q}"
    if part == "hi":
        position = f"least({position} + 1, n - 1)"
    return f"max(x) FILTER (WHERE i = {position})"


def edges_sql(q: int, source: str, value: str, by: str = "") -> str:
    """CTEs ``ordered`` and ``edges`` with lo_k, hi_k, f_k and edge_k per group."""
    over = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    parts = ", ".join(
        f"{edge_sql(q, k, 'lo')} AS lo_{k}, {edge_sql(q, k, 'hi')} AS hi_{k}, ((n - 1) * {k}) % {q} AS f_{k}"
        for k in range(q + 1)
    )
    edges = ", ".join(
        f"CAST(lo_{k} AS DOUBLE) + (CAST(hi_{k} AS DOUBLE) - CAST(lo_{k} AS DOUBLE)) * f_{k} / {q}::DOUBLE"
        f" AS edge_{k}"
        for k in range(q + 1)
    )
    return f"""ordered AS (
      SELECT {key}{value} AS x, row_number() OVER ({over} ORDER BY {value}) - 1 AS i, count(*) OVER ({over}) AS n
      FROM {source} WHERE {value} IS NOT NULL
    ), picked AS (SELECT {key}n, {parts} FROM ordered GROUP BY {key}n),
    edges AS (SELECT *, {edges} FROM picked)"""


R_SCORE = "CAST(5 - " + " - ".join(
    f"CASE WHEN 5 * (recency - lo_{k}) > f_{k} * (hi_{k} - lo_{k}) THEN 1 ELSE 0 END" for k in range(1, 5)
) + " AS INTEGER)"


def rank_score(rank: str) -> str:
    return f"CAST(greatest(1, (5 * ({rank} - 1) + n - 2) // (n - 1)) AS INTEGER)"


PNL = f"""{FACTS}, sums AS (
  SELECT {REVENUE} AS revenue, {COGS} AS cogs, CAST(coalesce(sum(delivery_cost), 0) AS DOUBLE) AS delivery_cost,
    CAST(coalesce(sum(discount), 0) AS DOUBLE) AS discount_cost, {PROFIT} AS gross_profit
  FROM facts WHERE kept
), opex AS (
  SELECT *, revenue * 0.08::DOUBLE AS marketing, revenue * 0.05::DOUBLE AS ops_overhead FROM sums
), net AS (SELECT *, gross_profit - marketing - ops_overhead AS net_profit FROM opex),
pnl AS (
  SELECT *, CASE WHEN revenue <> 0 THEN gross_profit / revenue * 100 ELSE 0 END AS gross_margin,
    CASE WHEN revenue <> 0 THEN net_profit / revenue * 100 ELSE 0 END AS net_margin
  FROM net
)"""

_STEPS = [
    ("Revenue", "relative", "revenue"),
    ("COGS", "relative", "-cogs"),
    ("Delivery Cost", "relative", "-delivery_cost"),
    ("Discount Cost", "relative", "-discount_cost"),
    ("Gross Profit", "total", "gross_profit"),
    ("Marketing", "relative", "-marketing"),
    ("Ops Overhead", "relative", "-ops_overhead"),
    ("Net Profit", "total", "net_profit"),
]


def _waterfall() -> str:
    rows, running = [], ""
    for number, (label, measure, amount) in enumerate(_STEPS, start=1):
        if measure == "relative":
            running = f"({running} + ({amount}))" if running else amount
        delta, reported = (amount, "NULL") if measure == "relative" else ("NULL", amount)
        rows.append(
            f"SELECT {number}::INTEGER AS step, '{label}' AS label, '{measure}' AS measure,"
            f" CAST({delta} AS DOUBLE) AS delta, CAST({reported} AS DOUBLE) AS reported_total,"
            f" {running} AS running_total FROM pnl"
        )
    return f"{PNL} {' UNION ALL '.join(rows)}"


def _costs() -> str:
    parts = {
        "COGS": "cogs",
        "Delivery Cost": "delivery_cost",
        "Discount Losses": "discount_cost",
        "Marketing": "marketing",
        "Ops Overhead": "ops_overhead",
    }
    whole = " + ".join(parts.values())
    return PNL + " UNION ALL ".join(
        f" SELECT '{label}' AS component, {c} AS amount, {c} / ({whole}) AS share FROM pnl"
        for label, c in parts.items()
    )


def histogram_sql(source: str, value: str, bins: int, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""limits AS (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM {source}),
    binned AS (
      SELECT {key}lo, (hi - lo) / {bins} AS width, CAST(least(coalesce(
        floor((CAST({value} AS DOUBLE) - lo) * {bins} / nullif(hi - lo, 0)), 0), {bins - 1}) AS INTEGER) AS bin
      FROM {source}, limits WHERE {value} IS NOT NULL
    ) SELECT {key}bin, lo + bin * width AS bin_start, lo + bin * width + width AS bin_end, {N} AS customers
    FROM binned GROUP BY {key}bin, lo, width"""


def retention_sql(counts: str) -> str:
    rates = ", ".join(
        f"count(*) FILTER (WHERE orders {test}) * CAST(100 AS DOUBLE) / count(*) AS {name}"
        for test, name in (("> 1", "repeat_rate"), (">= 5", "heavy_rate"), ("= 1", "one_time_rate"))
    )
    return f"{counts} SELECT {N} AS customers, {rates} FROM counts"


LINE_COUNTS = f"{FACTS}, counts AS (SELECT customer_id, count(*) AS orders FROM facts GROUP BY customer_id)"
ORDER_COUNTS = "WITH counts AS (SELECT o_custkey AS customer_id, count(*) AS orders FROM orders GROUP BY o_custkey)"

COHORT = f"""{FACTS}, firsts AS (
  SELECT customer_id, strftime(min(order_date), '%Y-%m') AS first_month FROM facts GROUP BY customer_id
), typed AS (
  SELECT f.*, CASE WHEN month = first_month THEN 'New' ELSE 'Returning' END AS customer_type
  FROM facts f JOIN firsts USING (customer_id)
)"""

_HEAT = ", ".join(f'CAST(count(*) FILTER (WHERE hour = {h}) AS BIGINT) AS "{h}"' for h in range(24))

BEHAVIOUR = f"""{FACTS}, metrics AS (
  SELECT customer_id, CAST(count(order_date) AS BIGINT) AS total_orders, {REVENUE} AS total_spend,
    CAST({half_even("sum(payment)", "count(*)")} AS DOUBLE) AS avg_order_value,
    CAST({half_even("10 * sum(disc)", "count(*)")} AS DOUBLE) / 10 AS avg_discount,
    CAST({half_even("100 * sum(review_score)", "count(*)")} AS DOUBLE) / 100 AS avg_rating,
    CAST({half_even("1000 * count(*) FILTER (WHERE NOT kept)", "count(*)")} AS DOUBLE) / 10 AS cancel_rate,
    CAST(median(hour(order_date)) AS DOUBLE) AS pref_hour
  FROM facts GROUP BY customer_id
), habits AS (
  SELECT metrics.*, c.category AS fav_category, d.device AS pref_device
  FROM metrics JOIN {mode_of("facts", "customer_id", "category")} c USING (customer_id)
    JOIN {mode_of("facts", "customer_id", "device")} d USING (customer_id)
)"""

CATALOGUE = f"""{FACTS}, products AS (
  SELECT category, {AVG_PRICE} AS avg_price, {AVG_RATING} AS avg_rating, {N} AS orders,
    {AVG_DISCOUNT} AS avg_discount,
    repeat('⭐', CAST({half_even("sum(review_score)", "count(*)")} AS INTEGER)) AS stars,
    CASE WHEN sum(disc) > 0 THEN '~' || CAST({half_even("sum(disc)", "count(*)")} AS VARCHAR) || '% off'
      ELSE '' END AS discount_label
  FROM facts GROUP BY category
) SELECT * FROM products"""

BANDED = f"""{RFM}, {edges_sql(5, "rfm", "recency")}, ranked AS (
    SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS f_rank,
      row_number() OVER (ORDER BY monetary, customer_id) AS m_rank FROM rfm
  ), scored AS (
    SELECT rfm.*, {R_SCORE} AS r_score, {rank_score("f_rank")} AS f_score, {rank_score("m_rank")} AS m_score
    FROM ranked AS rfm, edges
  ), {edges_sql(4, "rfm", "monetary").replace("ordered", "ordered4").replace("picked", "picked4").replace("edges", "edges4")},
  banded AS (
    SELECT scored.* EXCLUDE (f_rank, m_rank), r_score + f_score + m_score AS rfm_score,
      CASE WHEN 4 * (monetary - lo_1) <= f_1 * (hi_1 - lo_1) THEN 'Budget Buyers'
        WHEN 4 * (monetary - lo_2) <= f_2 * (hi_2 - lo_2) THEN 'Regular Customers'
        WHEN 4 * (monetary - lo_3) <= f_3 * (hi_3 - lo_3) THEN 'Loyal Customers' ELSE 'Top Customers' END AS segment,
      recency / (recency + 120::DOUBLE) AS churn_prob
    FROM scored, edges4
  ), risky AS (
    SELECT *, CASE WHEN churn_prob > 0.6::DOUBLE THEN 'High Risk' WHEN churn_prob > 0.35::DOUBLE THEN 'Medium Risk'
      ELSE 'Low Risk' END AS risk_level FROM banded
  )"""

_TABLE17 = "customer_id, segment, recency, frequency, monetary, avg_rating, rfm_score, city, gender, age_group"


def banded(keys: str, *measures: str) -> str:
    return f"{BANDED} SELECT {', '.join([keys, *measures])} FROM banded GROUP BY {keys}"


def box_sql(metric: str) -> str:
    edges = edges_sql(4, "banded", metric, "segment")
    for name in ("ordered", "picked", "edges"):
        edges = edges.replace(name, f"{name}_b")
    low, high = "edge_1 - (edge_3 - edge_1) * 1.5::DOUBLE", "edge_3 + (edge_3 - edge_1) * 1.5::DOUBLE"
    inside = f"{metric} >= {low} AND {metric} <= {high}"
    return f"""{BANDED}, {edges} SELECT segment, CAST(n AS BIGINT) AS customers, edge_0 AS minimum, edge_1 AS q1,
      edge_2 AS median, edge_3 AS q3, edge_4 AS maximum,
      CAST(min({metric}) FILTER (WHERE {inside}) AS DOUBLE) AS lower_whisker,
      CAST(max({metric}) FILTER (WHERE {inside}) AS DOUBLE) AS upper_whisker,
      CAST(count(*) FILTER (WHERE NOT ({inside})) AS BIGINT) AS outliers
    FROM banded JOIN edges_b USING (segment) GROUP BY ALL"""


def money_sql(x: str) -> str:
    return f"'₹' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def short_money_sql(x: str) -> str:
    return (
        f"CASE WHEN {x} < 1e6 THEN '₹' || printf('%.1f', round_even({x} / 1e3, 1)) || 'K'"
        f" ELSE '₹' || format('{{:,.2f}}', round_even({x} / 1e6, 2)) || 'M' END"
    )


def auto_histogram_sql(source: str, value: str, by: str = "") -> str:
    """Bins at multiples of a readable width: twice the interquartile range over the cube root of n, a 200th of the range at least."""
    key = f"{by}, " if by else ""
    edges = edges_sql(4, source, value)
    for name in ("ordered", "picked", "edges"):
        edges = edges.replace(name, f"{name}_h")
    return f"""{edges}, wide AS (
      SELECT greatest(2 * (edge_3 - edge_1) / pow(CAST(n AS DOUBLE), 1::DOUBLE / 3), (edge_4 - edge_0) / 200) AS w FROM edges_h
    ), steps AS (
      SELECT coalesce(CASE WHEN w > 0 THEN pow(10, floor(log10(w))) * CASE WHEN w <= pow(10, floor(log10(w))) THEN 1
        WHEN w <= 2 * pow(10, floor(log10(w))) THEN 2 WHEN w <= 5 * pow(10, floor(log10(w))) THEN 5 ELSE 10 END END, 1) AS step FROM wide
    ) SELECT {key}floor(CAST({value} AS DOUBLE) / step) * step AS bin_start,
      (floor(CAST({value} AS DOUBLE) / step) + 1) * step AS bin_end, {N} AS customers
    FROM {source}, steps WHERE {value} IS NOT NULL GROUP BY ALL"""


SCALED = f"""{RFM}, moments AS (
  SELECT avg(recency) AS m0, stddev_samp(recency) AS d0, avg(frequency) AS m1, stddev_samp(frequency) AS d1,
    avg(monetary) AS m2, stddev_samp(monetary) AS d2 FROM rfm
), points AS (
  SELECT customer_id, (recency - m0) / d0 AS x0, (frequency - m1) / d1 AS x1, (monetary - m2) / d2 AS x2 FROM rfm, moments
)"""


def _lloyd(k: int, before: str) -> str:
    """One round: customers to the nearest centre of ``before``, and the centres they move to."""
    apart = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(3))
    return f"""placed{k} AS (
      SELECT cluster, p.x0, p.x1, p.x2, {apart} AS apart, row_number() OVER (PARTITION BY customer_id ORDER BY {apart}, cluster) AS place
      FROM points p, {before} c
    ), centers{k} AS (SELECT cluster, avg(x0) AS x0, avg(x1) AS x1, avg(x2) AS x2 FROM placed{k} WHERE place = 1 GROUP BY cluster)"""


ROUNDS = f"""{SCALED}, starts AS (
  SELECT CAST(row_number() OVER (ORDER BY md5('42:' || customer_id), customer_id) - 1 AS INTEGER) AS cluster, x0, x1, x2
  FROM points ORDER BY md5('42:' || customer_id), customer_id LIMIT 4
), {_lloyd(1, "starts")}, {_lloyd(2, "centers1")}, {_lloyd(3, "centers2")}
SELECT cluster, round(x0, 6) AS recency, round(x1, 6) AS frequency, round(x2, 6) AS monetary,
  (SELECT round(sum(apart), 3) FROM placed3 WHERE place = 1) AS cost FROM centers2"""

GRID = f"""{RFM}, limits AS (SELECT min(recency)::DOUBLE AS lo0, max(recency)::DOUBLE AS hi0, min(frequency)::DOUBLE AS lo1,
    max(frequency)::DOUBLE AS hi1, min(monetary)::DOUBLE AS lo2, max(monetary)::DOUBLE AS hi2,
    min(avg_rating) AS lo3, max(avg_rating) AS hi3 FROM rfm), step AS (SELECT unnest(range(5)) / 4::DOUBLE AS s), grid AS (
  SELECT DISTINCT lo0 + (hi0 - lo0) * a.s AS recency, lo1 + (hi1 - lo1) * b.s AS frequency, lo2 + (hi2 - lo2) * c.s AS monetary,
    lo3 + (hi3 - lo3) * d.s AS avg_rating FROM limits, step a, step b, step c, step d
), risky AS (SELECT *, recency / (recency + 120::DOUBLE) AS churn_prob FROM grid)
SELECT *, CASE WHEN churn_prob > 0.6::DOUBLE THEN 'High Risk' WHEN churn_prob > 0.35::DOUBLE THEN 'Medium Risk'
  ELSE 'Low Risk' END AS risk_level FROM risky"""

_DAYS = 180
LATER = f"""{FACTS}, cut AS (SELECT max(order_date) - INTERVAL {_DAYS} DAY AS cut_at FROM facts), seen AS (
  SELECT customer_id, CAST(date_sub('day', max(order_date) FILTER (WHERE kept),
      (SELECT max(order_date) + INTERVAL 1 DAY FROM facts, cut WHERE order_date <= cut_at)) AS INTEGER) AS recency
  FROM facts, cut WHERE order_date <= cut_at AND customer_id IS NOT NULL GROUP BY customer_id HAVING count(*) FILTER (WHERE kept) > 0
), later AS (
  SELECT seen.*, CAST(customer_id NOT IN (SELECT customer_id FROM facts, cut WHERE kept AND order_date > cut_at AND customer_id IS NOT NULL) AS DOUBLE) AS label
  FROM seen
), held AS (
  SELECT customer_id, recency / (recency + 120::DOUBLE) AS score, label FROM later
  WHERE CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 250000
)"""

SALES = (
    f"{N} AS orders", f"{REVENUE} AS revenue", f"{AVG_PAID} AS avg_spend", f"{AVG_RATING} AS avg_rating",
    f"{AVG_DISCOUNT} AS avg_discount", f"{CANCEL_RATE} AS cancel_rate",
)

ORACLES: dict[str, str] = {
    # operators
    "a01_order_economics": f"""{FACTS} SELECT order_key, line_number, part_key, supplier_key,
      CAST(price_c AS DOUBLE) / 100 AS price, CAST(cogs_c AS DOUBLE) / 100 AS cogs,
      CAST(delivery_cost AS DOUBLE) AS delivery_cost, CAST(delivery_charge AS DOUBLE) AS delivery_charge,
      CAST(disc AS DOUBLE) AS discount_pct, CAST(discount AS DOUBLE) AS discount_amount,
      CAST(payment AS DOUBLE) AS payment_amount, CAST(profit_c AS DOUBLE) / 100 AS gross_profit,
      CASE WHEN payment > 0 THEN round_even(profit_c / (100 * payment) * 100::DOUBLE, 1) ELSE 0 END AS gross_margin_pct,
      order_status, category, review_score FROM facts""",
    "b03_calendar_parts": f"""{FACTS} SELECT CAST(year(order_date) AS INTEGER) AS year,
      CAST(month(order_date) AS INTEGER) AS month_number, month_name, weekday, day_of_week,
      CAST(hour(order_date) AS INTEGER) AS hour, {N} AS orders FROM facts GROUP BY ALL""",
    "b01_order_devices": """SELECT o_orderkey AS order_key, o_custkey AS customer_id, c_mktsegment AS device
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "b06_customer_attributes": f"""{FACTS}
      SELECT DISTINCT customer_id, gender, age_group, device, city FROM facts""",
    "c02_default_customer": f"""{FACTS}
      SELECT customer_id FROM facts ORDER BY {_SEQUENCE} LIMIT 1""",
    "d01_first_periods": f"""{FACTS}
      SELECT customer_id, CAST(date_trunc('month', min(order_date)) AS DATE) AS first_month, {N} AS orders
      FROM facts GROUP BY customer_id""",
    "e05_user_habits": f"""{EVENTS}
      SELECT customer_id, m.category AS fav_category, events, pref_hour FROM (
        SELECT customer_id, {N} AS events, CAST(median(hour) AS DOUBLE) AS pref_hour
        FROM facts GROUP BY customer_id)
      JOIN {mode_of("facts", "customer_id", "category")} m USING (customer_id)""",
    "e13_spend_box": f"""{RFM}, {edges_sql(4, "rfm", "monetary", "gender")}
      SELECT gender, CAST(n AS BIGINT) AS customers, edge_0 AS minimum, edge_1 AS q1, edge_2 AS median,
        edge_3 AS q3, edge_4 AS maximum,
        min(monetary) FILTER (WHERE monetary >= edge_1 - (edge_3 - edge_1) * 1.5::DOUBLE
          AND monetary <= edge_3 + (edge_3 - edge_1) * 1.5::DOUBLE) AS lower_whisker,
        max(monetary) FILTER (WHERE monetary >= edge_1 - (edge_3 - edge_1) * 1.5::DOUBLE
          AND monetary <= edge_3 + (edge_3 - edge_1) * 1.5::DOUBLE) AS upper_whisker,
        CAST(count(*) FILTER (WHERE monetary < edge_1 - (edge_3 - edge_1) * 1.5::DOUBLE
          OR monetary > edge_3 + (edge_3 - edge_1) * 1.5::DOUBLE) AS BIGINT) AS outliers
      FROM rfm JOIN edges USING (gender) GROUP BY ALL""",
    "f01_spend_rank": f"""{RFM}, ranked AS (
        SELECT customer_id, row_number() OVER (ORDER BY monetary, customer_id) AS spend_rank,
          count(*) OVER () AS n FROM rfm)
      SELECT customer_id, spend_rank, {rank_score("spend_rank")} AS m_score FROM ranked""",
    "f03_recency_quintiles": f"""{RFM}, {edges_sql(5, "rfm", "recency")}
      SELECT customer_id, recency, {R_SCORE} AS r_score FROM rfm, edges""",
    "f03_spend_quartiles_by_city": f"""{RFM}, {edges_sql(4, "rfm", "monetary", "city")}
      SELECT city, CAST(n AS BIGINT) AS customers, edge_0, edge_1, edge_2, edge_3, edge_4 FROM edges""",
    "g04_customer_sample": f"""{RFM} SELECT customer_id, recency, frequency FROM rfm
      ORDER BY md5('7:' || CAST(customer_id AS VARCHAR)), customer_id LIMIT 500""",
    "h01_distinct_categories": f"{FACTS} SELECT DISTINCT category FROM facts",
    "a02_shared_facts": grouped(
        "CAST(date_trunc('month', order_date) AS DATE) AS month_start, city", f"{N} AS orders", f"{REVENUE} AS revenue", f"{PROFIT} AS profit"
    ).replace("GROUP BY CAST(date_trunc('month', order_date) AS DATE) AS month_start, city", "GROUP BY ALL"),
    "a03_published_cities": f"""{FACTS} SELECT city AS "City", {REVENUE} AS "Revenue (₹)",
      CAST(count(DISTINCT customer_id) AS BIGINT) AS "Unique Customers" FROM facts WHERE city IS NOT NULL GROUP BY city""",
    "b09_filled_customers": f"""{RFM} SELECT c_custkey AS customer_id, c_mktsegment AS device, coalesce(frequency, 0) AS frequency,
      coalesce(monetary, 0) AS monetary, coalesce(avg_rating, 0) AS avg_rating
      FROM customer LEFT JOIN rfm ON c_custkey = customer_id""",
    "f05_named_clusters": f"""{BANDED} SELECT customer_id, CAST(CASE segment WHEN 'Budget Buyers' THEN 3 WHEN 'Regular Customers' THEN 1
      WHEN 'Loyal Customers' THEN 4 ELSE 2 END AS INTEGER) AS cluster, segment FROM banded""",
    "i01_scaled_features": f"""{SCALED} SELECT customer_id, round(x0, 6) AS recency, round(x1, 6) AS frequency, round(x2, 6) AS monetary FROM points""",
    "i02_two_rounds": ROUNDS,
    "i05_training_guard": f"""{RFM} SELECT {N} AS rows, CAST(count(DISTINCT recency > 180) AS BIGINT) AS classes,
      count(*) >= 20 AND count(DISTINCT recency > 180) >= 2 AS trainable FROM rfm""",
    "r50_formula_grid": GRID,
    "e03_sketched_customers": grouped("city", "CAST(count(DISTINCT customer_id) AS BIGINT) AS customers", "true AS close", where="city IS NOT NULL"),
    "e06_sketched_order_values": grouped(
        "category", "CAST(count(payment) AS BIGINT) AS orders", *[f"true AS close_{q}" for q in (25, 50, 75, 90)], where="category IS NOT NULL"
    ),
    "h01_categories_first_seen": f"""{FACTS}, firsts AS (
      SELECT category AS value, min(({_SEQUENCE})) AS seen FROM facts WHERE category IS NOT NULL GROUP BY category
    ) SELECT value, CAST(row_number() OVER (ORDER BY seen) AS INTEGER) AS place FROM firsts""",
    "h01_segments_first_seen": f"""{BANDED}, firsts AS (SELECT segment AS value, min(customer_id) AS seen FROM banded GROUP BY segment)
      SELECT value, CAST(row_number() OVER (ORDER BY seen) AS INTEGER) AS place FROM firsts""",
    "i06_later_labels": f"""{LATER} SELECT label, {N} AS customers, avg(recency) AS mean_recency FROM later GROUP BY label""",
    "i06_formula_holdout": f"""{LATER}, pairs AS (
      SELECT sum(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS won, count(*) AS pairs
      FROM held p JOIN held n ON p.label = 1 AND n.label = 0
    ), told AS (
      SELECT {N} AS rows, CAST(count(*) FILTER (label = 1) AS BIGINT) AS positives,
        CAST(count(*) FILTER (score > 0.6::DOUBLE AND label = 1) AS BIGINT) AS true_positives,
        CAST(count(*) FILTER (score > 0.6::DOUBLE AND label = 0) AS BIGINT) AS false_positives,
        CAST(count(*) FILTER (score <= 0.6::DOUBLE AND label = 1) AS BIGINT) AS false_negatives,
        CAST(count(*) FILTER (score <= 0.6::DOUBLE AND label = 0) AS BIGINT) AS true_negatives
      FROM held
    ) SELECT told.*, CAST(won AS DOUBLE) / pairs AS auc, true_positives / nullif(true_positives + false_positives, 0) AS precision,
      true_positives / nullif(true_positives + false_negatives, 0) AS recall FROM told, pairs""",
    "i06_formula_calibration": f"""{LATER} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS band, {N} AS rows,
      round(sum(score) / count(*), 6) AS mean_score, sum(label) / count(*) AS observed FROM held GROUP BY band""",
    "j02_auto_spend_histogram": f"{RFM}, {auto_histogram_sql('rfm', 'monetary')}",
    "r15_auto_recency_histogram": f"{BANDED}, {auto_histogram_sql('banded', 'recency', 'segment')}",
    "r16_auto_spend_histogram": f"{BANDED}, {auto_histogram_sql('banded', 'monetary', 'segment')}",
    "k01_streamed_days": f"""SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
      event_type AS category, {N} AS orders, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue
      FROM events GROUP BY ALL""",
    "k02_streamed_new_vs_returning": f"""WITH placed AS (
      SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS period, CAST(round(value * 100) AS BIGINT) AS amount FROM events
    ), typed AS (
      SELECT *, CASE WHEN period = min(period) OVER (PARTITION BY user_id) THEN 'New' ELSE 'Returning' END AS customer_type FROM placed
    ) SELECT period, customer_type, {N} AS orders, CAST(count(DISTINCT user_id) AS BIGINT) AS customers,
      CAST(sum(amount) AS DOUBLE) / 100 AS revenue FROM typed GROUP BY ALL""",
    "j02_spend_histogram": f"{RFM}, {histogram_sql('rfm', 'monetary', 30, 'gender')}",
    # dashboard
    "r01_executive_kpis": f"""{PNL} SELECT revenue, orders, avg_order_value, customers, avg_rating,
        net_profit, net_margin
      FROM pnl, (SELECT CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS orders,
        CAST(sum(payment) FILTER (WHERE kept) AS DOUBLE) / count(*) FILTER (WHERE kept) AS avg_order_value,
        CAST(count(DISTINCT customer_id) AS BIGINT) AS customers, {AVG_RATING} AS avg_rating FROM facts)""",
    "r01_kpi_texts": f"""{FACTS}, kpi AS (
        SELECT CAST(sum(payment) FILTER (WHERE kept) AS DOUBLE) AS revenue, count(*) FILTER (WHERE kept) AS orders,
          CAST(sum(payment) FILTER (WHERE kept) AS DOUBLE) / count(*) FILTER (WHERE kept) AS avg_order_value,
          count(DISTINCT customer_id) AS customers FROM facts)
      SELECT {money_sql("revenue")} AS revenue, {short_money_sql("revenue")} AS short_revenue,
        {money_sql("avg_order_value")} AS avg_order_value, {short_money_sql("avg_order_value")} AS short_order_value,
        printf('%.1f', round_even(orders / (orders + customers) * 100::DOUBLE, 1)) || '%' AS order_share FROM kpi""",
    "r02_extent": f"""{FACTS} SELECT {N} AS orders, CAST(min(order_date) AS DATE) AS first_date,
      CAST(max(order_date) AS DATE) AS last_date FROM facts""",
    "r03_monthly_revenue": grouped("month, month_name", f"{REVENUE} AS revenue", where="kept"),
    "r04_orders_by_status": f"""{FACTS}, counts AS (
        SELECT upper(order_status[1]) || lower(order_status[2:]) AS status, {N} AS orders
        FROM facts WHERE order_status IS NOT NULL GROUP BY 1)
      SELECT *, CAST(orders AS DOUBLE) / CAST(sum(orders) OVER () AS DOUBLE) AS share FROM counts""",
    "r05_revenue_by_city": grouped("city", f"{REVENUE} AS revenue", where="kept"),
    "r06_top_categories": grouped("category", f"{REVENUE} AS revenue", where="kept")
    + " ORDER BY revenue DESC, category LIMIT 5",
    "r07_weekday_hour_heatmap": grouped("weekday, day_of_week", _HEAT, base=EVENTS),
    # segmentation
    "r08_rfm_base": f"{RFM} SELECT * FROM rfm",
    "r09_rfm_scores": f"""{RFM}, {edges_sql(5, "rfm", "recency")}, ranked AS (
        SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS f_rank,
          row_number() OVER (ORDER BY monetary, customer_id) AS m_rank FROM rfm
      ), scored AS (
        SELECT customer_id, recency, frequency, monetary, {R_SCORE} AS r_score,
          {rank_score("f_rank")} AS f_score, {rank_score("m_rank")} AS m_score FROM ranked, edges)
      SELECT *, r_score + f_score + m_score AS rfm_score FROM scored""",
    "r11_quartile_sizes": f"""{BANDED} SELECT segment, {N} AS customers,
      CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM banded) AS DOUBLE) AS share FROM banded GROUP BY segment""",
    "r12_quartile_sample": f"""{BANDED} SELECT customer_id, recency, monetary, frequency, segment FROM banded
      ORDER BY md5('7:' || CAST(customer_id AS VARCHAR)), customer_id LIMIT 500""",
    "r13_quartile_averages": banded("segment", *[
        f"round_even(CAST(sum({c}) AS DOUBLE) / count({c}), 1) AS avg_{c.removeprefix('avg_')}"
        for c in ("recency", "frequency", "monetary", "avg_rating", "rfm_score")
    ]),
    **{f"r14_{metric}_box": box_sql(metric) for metric in ("recency", "frequency", "monetary", "rfm_score")},
    "r15_quartile_recency_histogram": f"{BANDED}, {histogram_sql('banded', 'recency', 30, 'segment')}",
    "r16_quartile_spend_histogram": f"{BANDED}, {histogram_sql('banded', 'monetary', 30, 'segment')}",
    "r17_quartile_table": f"{BANDED} SELECT {_TABLE17} FROM banded",
    "r17_top_quartiles_table": f"""{BANDED} SELECT {_TABLE17} FROM banded
      WHERE segment IN ('Loyal Customers', 'Top Customers')""",
    "r18_quartile_profile": banded(
        "segment", f"{N} AS customers", "CAST(sum(monetary) AS DOUBLE) / count(monetary) AS avg_spend",
        "CAST(sum(frequency) AS DOUBLE) / count(frequency) AS avg_orders",
        "CAST(sum(recency) AS DOUBLE) / count(recency) AS avg_recency",
    ),
    "r19_quartile_gender": f"""{BANDED}, counts AS (
        SELECT segment, gender, {N} AS customers FROM banded WHERE gender IS NOT NULL GROUP BY segment, gender)
      SELECT *, CAST(customers AS DOUBLE) / CAST(sum(customers) OVER (PARTITION BY segment) AS DOUBLE) AS share
      FROM counts""",
    "r20_quartile_age": banded("segment, age_group", f"{N} AS customers"),
    # behaviour
    "r21_orders_by_hour": grouped("hour", f"{N} AS orders", base=EVENTS),
    "r22_orders_by_weekday": grouped("weekday, day_of_week", f"{N} AS orders"),
    "r23_orders_by_month": grouped("month, month_name", f"{N} AS orders"),
    "r24_device_orders": grouped("device", f"{N} AS orders", f"{REVENUE} AS revenue"),
    "r25_gender_orders": grouped(
        "gender", f"{N} AS orders", f"{REVENUE} AS revenue",
        "CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM facts) AS DOUBLE) AS share",
    ),
    "r26_age_group_orders": grouped(
        "age_group", f"{N} AS orders", f"{REVENUE} AS revenue", f"{AVG_PAID} AS avg_spend"
    ),
    "r27_order_value_matrix": grouped("gender, age_group", f"{AVG_PAID} AS avg_order_value"),
    "r28_category_behaviour": grouped("category", *SALES),
    "r28_category_behaviour_rounded": f"""SELECT * REPLACE (round_even(revenue, 2) AS revenue,
        round_even(avg_spend, 2) AS avg_spend, round_even(avg_rating, 2) AS avg_rating,
        round_even(avg_discount, 2) AS avg_discount, round_even(cancel_rate, 2) AS cancel_rate)
      FROM ({grouped("category", *SALES)})""",
    "r29_spend_rating_bubbles": grouped("category", *SALES[:4]),
    "r30_cancel_ranking": grouped("category", SALES[5]),
    "r31_rating_distribution": grouped("review_score", f"{N} AS orders").replace(
        "SELECT review_score,", "SELECT review_score AS rating,"
    ),
    "r32_discount_by_age": grouped("age_group", f"{AVG_DISCOUNT} AS avg_discount", where="disc > 0"),
    "r33_rating_by_category": grouped("category", f"{AVG_RATING} AS avg_rating"),
    # profit and loss
    "r34_pnl_summary": f"{PNL} SELECT * FROM pnl",
    "r35_pnl_waterfall": _waterfall(),
    "r36_pnl_monthly": grouped(
        "month, month_name", f"{REVENUE} AS revenue", f"{COGS} AS cogs", f"{PROFIT} AS gross_profit",
        f"{N} AS orders", f"{PROFIT} - {REVENUE} * 0.13::DOUBLE AS net_profit", where="kept",
    ),
    "r37_pnl_by_category": grouped(
        "category", f"{REVENUE} AS revenue", f"{COGS} AS cogs", f"{PROFIT} AS gross_profit",
        f"{N} AS orders", f"{PROFIT} / {REVENUE} * 100 AS margin_pct", where="kept",
    ),
    "r38_cost_breakdown": _costs(),
    # retention and geography
    "r39_retention_rates": retention_sql(LINE_COUNTS),
    "r39_retention_rates_by_order": retention_sql(ORDER_COUNTS),
    "r40_orders_histogram": f"{LINE_COUNTS}, {histogram_sql('counts', 'orders', 20)}",
    "r40_orders_histogram_by_order": f"{ORDER_COUNTS}, {histogram_sql('counts', 'orders', 20)}",
    "r41_top_customers": grouped("customer_id", f"{REVENUE} AS total_spend")
    + " ORDER BY total_spend DESC, customer_id LIMIT 10",
    "r42_new_vs_returning_orders": f"""{COHORT} SELECT month, customer_type, {N} AS orders,
      CAST(count(DISTINCT customer_id) AS BIGINT) AS customers FROM typed GROUP BY month, customer_type""",
    "r43_new_vs_returning_revenue": f"""{COHORT} SELECT month, customer_type, {REVENUE} AS revenue
      FROM typed GROUP BY month, customer_type""",
    "r44_geo_table": grouped(
        "city", f"{REVENUE} AS revenue", f"{N} AS orders",
        "CAST(count(DISTINCT customer_id) AS BIGINT) AS customers", f"{AVG_PAID} AS avg_order_value",
    ),
    "r45_geo_treemap": grouped(
        "city", f"{REVENUE} AS revenue", f"{AVG_PAID} AS avg_order_value",
        f"{REVENUE} / (SELECT {REVENUE} FROM facts) AS share",
    ),
    # churn risk
    "r47_formula_scores": f"""{BANDED} SELECT customer_id, segment, recency, frequency, monetary, avg_rating,
      churn_prob, risk_level FROM risky""",
    "r48_formula_mix": f"""{BANDED}, levels AS (
        SELECT unnest(['High Risk', 'Medium Risk', 'Low Risk']) AS risk_level
      ), counts AS (
        SELECT risk_level, CAST(count(customer_id) AS BIGINT) AS customers
        FROM levels LEFT JOIN risky USING (risk_level) GROUP BY risk_level)
      SELECT *, CAST(customers AS DOUBLE) / CAST(sum(customers) OVER () AS DOUBLE) AS share FROM counts""",
    "r49_formula_histogram": f"{BANDED}, {histogram_sql('risky', 'churn_prob', 30)}",
    "r51_formula_list": f"""{BANDED} SELECT customer_id, segment, recency AS days_inactive, frequency AS orders,
      monetary AS total_spend, avg_rating, printf('%.1f', round_even(churn_prob * 100, 1)) || '%' AS churn_risk, city
      FROM risky WHERE risk_level = 'High Risk'""",
    "r52_churn_labels": f"""{RFM} SELECT CAST(recency > 180 AS INTEGER) AS at_risk, {N} AS customers
      FROM rfm GROUP BY 1""",
    # product
    "r53_category_stats": grouped(
        "category", SALES[0], SALES[1], f"{AVG_PRICE} AS avg_price", *SALES[3:],
        "CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers",
    ),
    "r53_category_matrix": grouped("category", SALES[1], SALES[3], SALES[4]),
    "r54_category_drill_kpis": grouped(
        "category", SALES[0], SALES[1], f"{AVG_PRICE} AS avg_price", SALES[3]
    ),
    "r54_category_drill_months": grouped("category, month, month_name", SALES[1]),
    "r54_category_drill_cities": grouped("category, city", SALES[1]),
    "r54_one_category_kpis": grouped(
        "category", SALES[0], SALES[1], f"{AVG_PRICE} AS avg_price", SALES[3], where="category = 'PROMO'"
    ),
    "r54_one_category_months": grouped("category, month, month_name", SALES[1], where="category = 'PROMO'"),
    # customers
    "r55_behaviour_features": f"{BEHAVIOUR} SELECT * FROM habits",
    "r56_customer_home": grouped(
        "customer_id", f"{N} AS total_orders", f"{REVENUE} AS total_spent", f"{AVG_RATING} AS avg_rating",
        "CAST(coalesce(sum(discount), 0) AS DOUBLE) AS savings",
    ),
    "r56_one_customer_home": grouped(
        "customer_id", f"{N} AS total_orders", f"{REVENUE} AS total_spent", f"{AVG_RATING} AS avg_rating",
        "CAST(coalesce(sum(discount), 0) AS DOUBLE) AS savings", where="customer_id = 1",
    ),
    "r56_customer_home_with_quartile": f"""{BANDED}, homes AS (
        SELECT customer_id, {N} AS total_orders, {REVENUE} AS total_spent, {AVG_RATING} AS avg_rating,
          CAST(coalesce(sum(discount), 0) AS DOUBLE) AS savings FROM facts GROUP BY customer_id)
      SELECT homes.*, coalesce(segment, 'Regular Customers') AS segment, c.category AS fav_category,
        d.device AS pref_device
      FROM homes LEFT JOIN banded USING (customer_id)
        LEFT JOIN {mode_of("facts", "customer_id", "category")} c USING (customer_id)
        LEFT JOIN {mode_of("facts", "customer_id", "device")} d USING (customer_id)""",
    "r57_one_customer_monthly_spend": grouped(
        "customer_id, month, month_name", f"{REVENUE} AS spent", where="customer_id = 1"
    ),
    "r57_customer_monthly_spend": grouped("customer_id, month, month_name", f"{REVENUE} AS spent"),
    "r57_customer_category_shares": f"""{FACTS}, spend AS (
        SELECT customer_id, category, {REVENUE} AS spent FROM facts GROUP BY customer_id, category)
      SELECT *, spent / sum(spent) OVER (PARTITION BY customer_id) AS share FROM spend""",
    "r57_customer_status_counts": grouped("customer_id, order_status", f"{N} AS orders"),
    "r58_shop_catalogue": CATALOGUE,
    "r58_shop_search": f"{CATALOGUE} WHERE regexp_matches(lower(category), '^(s|me)')",
    "r58_shop_by_price_down": CATALOGUE,
    "r58_shop_by_rating": CATALOGUE,
    "r58_shop_literal_search": f"{CATALOGUE} WHERE contains(lower(category), 'mo')",
    "r58_shop_one_category": f"{CATALOGUE} WHERE category = 'PROMO'",
    "r59_delivered_totals": grouped(
        "customer_id", f"{N} AS orders", f"{REVENUE} AS total_value", f"{AVG_PAID} AS avg_order_value",
        where="order_status = 'delivered'",
    ),
    "r59_one_customer_totals": f"""{FACTS} SELECT {N} AS orders, {REVENUE} AS total_value,
      coalesce({AVG_PAID}, 0) AS avg_order_value FROM facts WHERE customer_id = 1 AND order_status = 'shipped'""",
    "r59_one_customer_orders": f"""{FACTS} SELECT order_date AS "Date", category AS "Category",
      CAST(price_c AS DOUBLE) / 100 AS "Price (₹)", CAST(discount AS DOUBLE) AS "Discount (₹)",
      CAST(payment AS DOUBLE) AS "Paid (₹)", review_score AS "Rating", order_status AS "Status", city AS "City"
      FROM facts WHERE customer_id = 1""",
    "r59_order_totals": grouped(
        "customer_id", f"{N} AS orders", f"{REVENUE} AS total_value", f"{AVG_PAID} AS avg_order_value"
    ),
    "r59_order_list": f"""{FACTS} SELECT customer_id, order_date, category,
      CAST(price_c AS DOUBLE) / 100 AS price, CAST(discount AS DOUBLE) AS discount_amount,
      CAST(payment AS DOUBLE) AS payment_amount, review_score, order_status, city FROM facts""",
    "r60_customer_profile": f"""{BEHAVIOUR} SELECT customer_id, total_orders, total_spend, avg_order_value,
      cancel_rate, fav_category, pref_device, avg_discount, avg_rating FROM habits""",
    "r61_weekday_spend": grouped("customer_id, weekday, day_of_week", f"{REVENUE} AS spent"),
}

ORACLES["a02_refreshed_pnl"] = ORACLES["r37_pnl_by_category"]
