"""DuckDB statements that compute every report independently of Spark.

Each statement starts with the adapter prelude: the same derivation as
:mod:`mercato.sources.generated`, written as CTEs over the raw views the checker
registers (``customer nation orders lineitem part supplier``). The bodies follow
the reference semantics directly (joins at line grain, ``COUNT(DISTINCT ...)``,
a window ``DENSE_RANK``, a one-level running sum, a plain self-join for pairs),
so they check the Spark rewrites rather than repeat them. Rounding uses the
same exact integer forms as :mod:`mercato.functions.money`.
"""

from __future__ import annotations

import re

# --- adapter prelude (FIXTURES.md A) -------------------------------------------------

PRELUDE: dict[str, str] = {
    "m_customers": """
    SELECT cu.c_custkey AS customer_id,
           CASE WHEN cu.c_custkey % 10 = 0 THEN cu.c_custkey + 1 ELSE cu.c_custkey END
               AS customer_unique_id,
           na.n_name AS customer_state
    FROM customer cu JOIN nation na ON cu.c_nationkey = na.n_nationkey""",
    "m_last_ship": """
    SELECT l_orderkey, MAX(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey""",
    "m_orders": """
    SELECT od.o_orderkey AS order_id,
           od.o_custkey AS customer_id,
           CASE od.o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                ELSE 'canceled' END AS order_status,
           od.o_orderdate AS order_purchase_timestamp,
           CASE WHEN od.o_orderstatus = 'F' THEN ls.last_ship END
               AS order_delivered_customer_date
    FROM orders od LEFT JOIN m_last_ship ls ON ls.l_orderkey = od.o_orderkey""",
    "m_items": """
    SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
           CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
                AS DECIMAL(18,2)) AS freight_value
    FROM lineitem""",
    "m_products": """
    SELECT p_partkey AS product_id,
           CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_brand END AS product_category_name
    FROM part""",
    "m_translation": """
    SELECT DISTINCT p_brand AS product_category_name,
           lower(replace(p_brand, '#', '_')) AS product_category_name_english
    FROM part WHERE p_brand <> 'Brand#13'""",
    "m_sellers": """
    SELECT s_suppkey AS seller_id FROM supplier""",
    "m_payments": """
    SELECT l_orderkey AS order_id,
           CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto'
                ELSE 'voucher' END AS payment_type,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS payment_value
    FROM lineitem""",
}
_DEPENDS = {"m_orders": ("m_last_ship",)}


def _with_prelude(ctes: str, body: str, prelude: bool = True) -> str:
    text = ctes + body
    if not prelude:
        # the m_* names then refer to logical tables registered under those names
        return ("WITH " + ctes.strip() + "\n" if ctes.strip() else "") + body.strip()
    needed = [name for name in PRELUDE if re.search(rf"\b{name}\b", text)]
    for name in list(needed):
        for dep in _DEPENDS.get(name, ()):
            if dep not in needed:
                needed.insert(0, dep)
    order = [name for name in PRELUDE if name in needed]
    parts = [f"{name} AS ({PRELUDE[name]}\n)" for name in order]
    if ctes.strip():
        parts.append(ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


# --- exact rounding in SQL (same integer forms as mercato.functions.money) ------------


def money(expr: str) -> str:
    return f"CAST(ROUND({expr}, 2) AS DOUBLE)"


def _half_up(n: str, k: str) -> str:
    return f"CASE WHEN ({k}) <> 0 THEN (2 * ({n}) + ({k})) // (2 * ({k})) END"


def mean2(total: str, count: str) -> str:
    n = f"CAST(({total}) * 100 AS HUGEINT)"
    return f"CAST({_half_up(n, f'CAST(({count}) AS HUGEINT)')} AS DOUBLE) / 100"


def pct2(part: str, whole: str) -> str:
    n = f"10000 * CAST(({part}) AS HUGEINT)"
    return f"CAST({_half_up(n, f'CAST(({whole}) AS HUGEINT)')} AS DOUBLE) / 100"


def pct2_money(part: str, whole: str) -> str:
    return pct2(f"({part}) * 100", f"({whole}) * 100")


def pct_raw(part: str, whole: str) -> str:
    return f"CAST(100.0 AS DOUBLE) * ({part}) / ({whole})"


REV = "(li.price + li.freight_value)"
DLV = "od.order_status = 'delivered'"

# repeat persons, definition (c): more than one delivered order
RC = """rc AS (
    SELECT cu.customer_unique_id
    FROM m_customers cu JOIN m_orders od ON od.customer_id = cu.customer_id
    WHERE od.order_status = 'delivered'
    GROUP BY cu.customer_unique_id
    HAVING COUNT(DISTINCT od.order_id) > 1
)"""

# the same by order rows: three of the reports count without DISTINCT
RC_ROWS = RC.replace("COUNT(DISTINCT od.order_id)", "COUNT(od.order_id)")

# order value, definition (d): delivered orders with lines, per person
OV = f"""ov AS (
    SELECT cu.customer_unique_id, od.order_id, SUM({REV}) AS order_total
    FROM m_orders od
    JOIN m_items li ON li.order_id = od.order_id
    JOIN m_customers cu ON cu.customer_id = od.customer_id
    WHERE {DLV}
    GROUP BY cu.customer_unique_id, od.order_id
),
ovr AS (
    SELECT customer_unique_id FROM ov GROUP BY customer_unique_id HAVING COUNT(order_id) > 1
)"""

CAT = """JOIN m_products pr ON pr.product_id = li.product_id
    JOIN m_translation tr ON tr.product_category_name = pr.product_category_name"""

REPEAT_LINES = f"""FROM rc
    JOIN m_customers cu ON cu.customer_unique_id = rc.customer_unique_id
    JOIN m_orders od ON od.customer_id = cu.customer_id
    JOIN m_items li ON li.order_id = od.order_id"""


def _person_orders(status_filter: bool, items: bool) -> str:
    join_items = "JOIN m_items li ON li.order_id = od.order_id" if items else ""
    where = f"WHERE {DLV}" if status_filter else ""
    return f"""FROM m_customers cu
    JOIN m_orders od ON od.customer_id = cu.customer_id
    {join_items}
    {where}"""


STATEMENTS: dict[str, tuple[str, str]] = {
    # ---- section 1 ----
    "orders_by_state": ("", f"""
SELECT cu.customer_state, COUNT(od.order_id) AS total_orders
{_person_orders(True, False)}
GROUP BY cu.customer_state
ORDER BY total_orders DESC"""),
    "revenue_by_state": ("", f"""
SELECT cu.customer_state,
       COUNT(DISTINCT od.order_id) AS total_orders,
       {money(f'SUM({REV})')} AS total_revenue
{_person_orders(True, True)}
GROUP BY cu.customer_state
ORDER BY total_revenue DESC"""),
    "revenue_by_category": ("", f"""
SELECT tr.product_category_name_english, {money('SUM(li.price)')} AS total_revenue
FROM m_items li
    {CAT}
WHERE pr.product_category_name IS NOT NULL
GROUP BY tr.product_category_name_english
ORDER BY total_revenue DESC"""),
    "items_sold_by_category": ("", f"""
SELECT tr.product_category_name_english AS category, COUNT(*) AS total_item_sold
FROM m_items li
    {CAT}
    JOIN m_orders od ON od.order_id = li.order_id
WHERE {DLV}
GROUP BY tr.product_category_name_english
ORDER BY total_item_sold DESC"""),
    "top_revenue_month": ("", f"""
SELECT CAST(year(od.order_purchase_timestamp) AS BIGINT) AS "year",
       CAST(month(od.order_purchase_timestamp) AS BIGINT) AS "month",
       {money(f'SUM({REV})')} AS revenue
FROM m_orders od JOIN m_items li ON li.order_id = od.order_id
WHERE {DLV}
GROUP BY 1, 2
ORDER BY revenue DESC, "year", "month"
LIMIT 1"""),
    "top_revenue_state": ("", f"""
SELECT cu.customer_state, {money(f'SUM({REV})')} AS total_revenue
{_person_orders(True, True)}
GROUP BY cu.customer_state
ORDER BY total_revenue DESC, cu.customer_state
LIMIT 1"""),
    "monthly_revenue": ("", f"""
SELECT strftime(od.order_purchase_timestamp, '%Y-%m') AS year_month,
       {money(f'SUM({REV})')} AS total_revenue
FROM m_orders od JOIN m_items li ON li.order_id = od.order_id
WHERE {DLV}
GROUP BY 1
ORDER BY year_month"""),
    # ---- section 2 ----
    "customer_spend": ("", f"""
SELECT cu.customer_unique_id, {money(f'SUM({REV})')} AS total_money_spent
{_person_orders(True, True)}
GROUP BY cu.customer_unique_id
ORDER BY total_money_spent DESC"""),
    "customer_type": ("", f"""
SELECT cu.customer_unique_id,
       COUNT(DISTINCT od.order_id) AS total_orders,
       CASE WHEN COUNT(DISTINCT od.order_id) = 1 THEN 'One-time buyer'
            ELSE 'Repeat customer' END AS customer_type
{_person_orders(False, False)}
GROUP BY cu.customer_unique_id
ORDER BY total_orders DESC"""),
    "repeat_customer_pct": (f"""
per_person AS (
    SELECT cu.customer_unique_id, COUNT(DISTINCT od.order_id) AS n
    {_person_orders(False, False)}
    GROUP BY cu.customer_unique_id
)""", f"""
SELECT {pct_raw('SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END)', 'COUNT(*)')}
       AS repeat_customer_percentage
FROM per_person"""),
    "avg_orders_repeat": (f"""
per_person AS (
    SELECT cu.customer_unique_id, COUNT(DISTINCT od.order_id) AS n
    {_person_orders(False, False)}
    GROUP BY cu.customer_unique_id
    HAVING COUNT(DISTINCT od.order_id) > 1
)""", """
SELECT CAST(SUM(n) // COUNT(*) AS BIGINT) AS avg_order_repeat_customers FROM per_person"""),
    "avg_revenue_repeat": (f"""
per_person AS (
    SELECT cu.customer_unique_id, SUM({REV}) AS total_revenue
    {_person_orders(False, True)}
    GROUP BY cu.customer_unique_id
    HAVING COUNT(DISTINCT od.order_id) > 1
)""", f"""
SELECT {mean2('SUM(total_revenue)', 'COUNT(total_revenue)')} AS avg_evenue_repeat_customer
FROM per_person"""),
    "avg_revenue_one_time": (f"""
per_person AS (
    SELECT cu.customer_unique_id, SUM({REV}) AS total_revenue
    {_person_orders(False, True)}
    GROUP BY cu.customer_unique_id
    HAVING COUNT(DISTINCT od.order_id) = 1
)""", f"""
SELECT {mean2('SUM(total_revenue)', 'COUNT(total_revenue)')} AS avg_Revenue_one_time_customer
FROM per_person"""),
    "customer_revenue_rank": (f"""
per_person AS (
    SELECT cu.customer_unique_id, ROUND(SUM({REV}), 2) AS lifetime
    {_person_orders(True, True)}
    GROUP BY cu.customer_unique_id
)""", """
SELECT customer_unique_id,
       CAST(lifetime AS DOUBLE) AS lifetime_revenue,
       CAST(DENSE_RANK() OVER (ORDER BY lifetime DESC NULLS LAST) AS BIGINT) AS revenue_rank
FROM per_person
ORDER BY revenue_rank"""),
    "customer_first_last_order": ("", f"""
SELECT cu.customer_unique_id,
       MIN(od.order_purchase_timestamp) AS old,
       MAX(od.order_purchase_timestamp) AS latest
{_person_orders(True, False)}
GROUP BY cu.customer_unique_id
ORDER BY cu.customer_unique_id"""),
    "delivery_gap_days": (f"""
deliveries AS (
    SELECT cu.customer_unique_id,
           od.order_delivered_customer_date AS cur,
           LAG(od.order_delivered_customer_date) OVER (
               PARTITION BY cu.customer_unique_id
               ORDER BY od.order_delivered_customer_date) AS prev
    {_person_orders(True, False)}
      AND od.order_delivered_customer_date IS NOT NULL
)""", """
SELECT customer_unique_id,
       prev AS previous_delivered_date,
       cur AS current_delivered_date,
       CAST(date_diff('day', prev, cur) AS BIGINT) AS gap_days
FROM deliveries
WHERE prev IS NOT NULL
ORDER BY gap_days DESC, customer_unique_id, current_delivered_date"""),
    "customer_lifetime_days": ("", f"""
SELECT cu.customer_unique_id,
       MIN(od.order_delivered_customer_date) AS first_delivered_date,
       MAX(od.order_delivered_customer_date) AS last_delivered_date,
       CAST(date_diff('day', MIN(od.order_delivered_customer_date),
                      MAX(od.order_delivered_customer_date)) AS BIGINT) AS lifetime_days
{_person_orders(True, False)}
  AND od.order_delivered_customer_date IS NOT NULL
GROUP BY cu.customer_unique_id
ORDER BY lifetime_days DESC"""),
    "order_frequency_buckets": (f"""
per_person AS (
    SELECT cu.customer_unique_id, COUNT(DISTINCT od.order_id) AS n
    {_person_orders(True, False)}
    GROUP BY cu.customer_unique_id
),
grouped AS (
    SELECT CASE WHEN n = 1 THEN '1 Order' WHEN n = 2 THEN '2 Orders'
                WHEN n = 3 THEN '3 Orders' ELSE '4+ Orders' END AS order_frequency_group,
           CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 2 WHEN n = 3 THEN 3 ELSE 4 END AS sort_key,
           COUNT(*) AS number_of_customers
    FROM per_person
    GROUP BY 1, 2
)""", f"""
SELECT order_frequency_group, number_of_customers,
       CAST(CAST(CAST({_half_up('10000 * CAST(number_of_customers AS HUGEINT)',
                                'CAST(SUM(number_of_customers) OVER () AS HUGEINT)')}
                      AS DECIMAL(7,0)) / 100 AS DECIMAL(5,2)) AS DOUBLE) AS percentage
FROM grouped
ORDER BY sort_key"""),
    # ---- section 3 ----
    "repeat_items_by_category": (RC, f"""
SELECT tr.product_category_name_english AS product_category,
       COUNT(li.order_id) AS items_bought_by_repeat_customers
{REPEAT_LINES}
    {CAT}
WHERE {DLV}
GROUP BY tr.product_category_name_english
ORDER BY items_bought_by_repeat_customers DESC"""),
    "repeat_orders_by_seller": (RC, f"""
SELECT se.seller_id AS repeated_seller, COUNT(DISTINCT li.order_id) AS orders_by_repeat_customers
{REPEAT_LINES}
    JOIN m_sellers se ON se.seller_id = li.seller_id
WHERE {DLV}
GROUP BY se.seller_id
ORDER BY orders_by_repeat_customers DESC"""),
    "repeat_customers_by_state": (RC, """
SELECT cu.customer_state, COUNT(DISTINCT rc.customer_unique_id) AS repeat_customers_count
FROM rc JOIN m_customers cu ON cu.customer_unique_id = rc.customer_unique_id
GROUP BY cu.customer_state
ORDER BY repeat_customers_count DESC"""),
    "repeat_pct_by_state": (RC, f"""
SELECT cu.customer_state,
       COUNT(DISTINCT cu.customer_unique_id) AS total_customers,
       COUNT(DISTINCT rc.customer_unique_id) AS repeat_customers,
       {pct_raw('COUNT(DISTINCT rc.customer_unique_id)', 'COUNT(DISTINCT cu.customer_unique_id)')}
           AS repeat_customer_percentage
FROM m_customers cu
    JOIN m_orders od ON od.customer_id = cu.customer_id AND od.order_status = 'delivered'
    LEFT JOIN rc ON rc.customer_unique_id = cu.customer_unique_id
GROUP BY cu.customer_state
ORDER BY repeat_customer_percentage DESC"""),
    "repeat_pct_by_category": (RC + f""",
person_category AS (
    SELECT DISTINCT cu.customer_unique_id, tr.product_category_name_english
    FROM m_customers cu
        JOIN m_orders od ON od.customer_id = cu.customer_id AND od.order_status = 'delivered'
        JOIN m_items li ON li.order_id = od.order_id
        {CAT}
)""", f"""
SELECT pc.product_category_name_english,
       COUNT(DISTINCT pc.customer_unique_id) AS total_customers,
       COUNT(DISTINCT rc.customer_unique_id) AS repeat_customers,
       {pct2('COUNT(DISTINCT rc.customer_unique_id)', 'COUNT(DISTINCT pc.customer_unique_id)')}
           AS repeat_customer_by_category_percentage
FROM person_category pc LEFT JOIN rc ON rc.customer_unique_id = pc.customer_unique_id
GROUP BY pc.product_category_name_english
ORDER BY repeat_customer_by_category_percentage DESC"""),
    "repeat_revenue_by_category": (RC_ROWS, f"""
SELECT tr.product_category_name_english AS product_category,
       {money(f'SUM({REV})')} AS revenue_from_repeat_customers
FROM m_orders od
    JOIN m_items li ON li.order_id = od.order_id
    {CAT}
    JOIN m_customers cu ON cu.customer_id = od.customer_id
    JOIN rc ON rc.customer_unique_id = cu.customer_unique_id
WHERE {DLV}
GROUP BY tr.product_category_name_english
ORDER BY revenue_from_repeat_customers DESC"""),
    "repeat_revenue_by_seller": (RC_ROWS, f"""
SELECT li.seller_id, {money(f'SUM({REV})')} AS revenue_from_repeat_customers
FROM m_orders od
    JOIN m_items li ON li.order_id = od.order_id
    JOIN m_customers cu ON cu.customer_id = od.customer_id
    JOIN rc ON rc.customer_unique_id = cu.customer_unique_id
WHERE {DLV}
GROUP BY li.seller_id
ORDER BY revenue_from_repeat_customers DESC"""),
    "repeat_orders_by_category": (RC, f"""
SELECT tr.product_category_name_english AS product_category,
       COUNT(DISTINCT li.order_id) AS orders_by_repeat_customers
FROM m_orders od
    JOIN m_items li ON li.order_id = od.order_id
    {CAT}
    JOIN m_customers cu ON cu.customer_id = od.customer_id
    JOIN rc ON rc.customer_unique_id = cu.customer_unique_id
WHERE {DLV}
GROUP BY tr.product_category_name_english
ORDER BY orders_by_repeat_customers DESC"""),
    "seller_repeat_dependency": (RC_ROWS + f""",
seller_total AS (
    SELECT li.seller_id, ROUND(SUM({REV}), 2) AS total_revenue
    FROM m_orders od JOIN m_items li ON li.order_id = od.order_id
    WHERE {DLV}
    GROUP BY li.seller_id
),
seller_repeat AS (
    SELECT li.seller_id, ROUND(SUM({REV}), 2) AS repeat_revenue
    FROM m_orders od
        JOIN m_items li ON li.order_id = od.order_id
        JOIN m_customers cu ON cu.customer_id = od.customer_id
        JOIN rc ON rc.customer_unique_id = cu.customer_unique_id
    WHERE {DLV}
    GROUP BY li.seller_id
)""", f"""
SELECT st.seller_id,
       CAST(st.total_revenue AS DOUBLE) AS total_revenue,
       CAST(COALESCE(sr.repeat_revenue, 0) AS DOUBLE) AS repeat_revenue,
       {pct2_money('COALESCE(sr.repeat_revenue, 0)', 'st.total_revenue')} AS repeat_revenue_percent
FROM seller_total st LEFT JOIN seller_repeat sr ON sr.seller_id = st.seller_id
ORDER BY repeat_revenue_percent DESC"""),
    # ---- section 4 ----
    "aov_by_segment": (OV + """,
segment AS (
    SELECT customer_unique_id,
           CASE WHEN COUNT(order_id) > 1 THEN 'Repeat Customer'
                ELSE 'One-Time Customer' END AS customer_segment
    FROM ov GROUP BY customer_unique_id
)""", f"""
SELECT sg.customer_segment, {mean2('SUM(ov.order_total)', 'COUNT(ov.order_total)')} AS AOV
FROM ov JOIN segment sg ON sg.customer_unique_id = ov.customer_unique_id
GROUP BY sg.customer_segment"""),
    "repeat_aov_by_seller": (OV, f"""
SELECT li.seller_id,
       {mean2('SUM(ov.order_total)', 'COUNT(ov.order_total)')} AS AOV_from_repeat_customers
FROM ov
    JOIN ovr ON ovr.customer_unique_id = ov.customer_unique_id
    JOIN m_items li ON li.order_id = ov.order_id
GROUP BY li.seller_id
ORDER BY AOV_from_repeat_customers DESC"""),
    "repeat_aov_by_category": (OV + f""",
order_category AS (
    SELECT DISTINCT od.order_id, tr.product_category_name_english AS product_category
    FROM m_orders od
        JOIN m_items li ON li.order_id = od.order_id
        {CAT}
)""", f"""
SELECT oc.product_category,
       {mean2('SUM(ov.order_total)', 'COUNT(ov.order_total)')} AS AOV_from_repeat_customers
FROM ov
    JOIN ovr ON ovr.customer_unique_id = ov.customer_unique_id
    JOIN order_category oc ON oc.order_id = ov.order_id
GROUP BY oc.product_category
ORDER BY AOV_from_repeat_customers DESC"""),
    "cumulative_revenue": (f"""
daily AS (
    SELECT CAST(od.order_purchase_timestamp AS DATE) AS order_date,
           ROUND(SUM({REV}), 2) AS revenue
    FROM m_orders od JOIN m_items li ON li.order_id = od.order_id
    WHERE {DLV}
    GROUP BY 1
)""", """
SELECT order_date,
       CAST(revenue AS DOUBLE) AS revenue,
       CAST(ROUND(SUM(revenue) OVER (ORDER BY order_date
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE)
           AS cumulative_revenue
FROM daily
ORDER BY order_date"""),
    "revenue_by_payment_type": (f"""
by_type AS (
    SELECT py.payment_type,
           SUM(py.payment_value) AS total,
           COUNT(DISTINCT py.order_id) AS total_orders
    FROM m_orders od JOIN m_payments py ON py.order_id = od.order_id
    WHERE {DLV}
    GROUP BY py.payment_type
)""", f"""
SELECT payment_type,
       {money('total')} AS total_revenue,
       total_orders,
       {pct2_money('total', 'SUM(total) OVER ()')} AS revenue_share_percent
FROM by_type
ORDER BY total DESC"""),
    "revenue_by_weekday": ("", f"""
SELECT dayname(od.order_purchase_timestamp) AS day_of_week,
       {money(f'SUM({REV})')} AS total_revenue
FROM m_orders od JOIN m_items li ON li.order_id = od.order_id
WHERE {DLV}
GROUP BY 1
ORDER BY total_revenue DESC"""),
    # ---- section 6 ----
    "products_bought_together": ("", """
SELECT a.product_id AS product_1, b.product_id AS product_2, COUNT(*) AS times_bought_together
FROM m_items a JOIN m_items b ON a.order_id = b.order_id AND a.product_id < b.product_id
GROUP BY a.product_id, b.product_id
ORDER BY times_bought_together DESC"""),
    "top_revenue_category": ("", f"""
SELECT tr.product_category_name_english AS product_category,
       {money(f'SUM({REV})')} AS highest_total_revenue
FROM m_items li
    {CAT}
    JOIN m_orders od ON od.order_id = li.order_id
WHERE {DLV}
GROUP BY tr.product_category_name_english
ORDER BY highest_total_revenue DESC, product_category
LIMIT 1"""),
    "top_product_per_category": (f"""
product_revenue AS (
    SELECT tr.product_category_name_english AS category, pr.product_id,
           ROUND(SUM(li.price), 2) AS revenue
    FROM m_orders od
        JOIN m_items li ON li.order_id = od.order_id
        {CAT}
    WHERE {DLV}
    GROUP BY tr.product_category_name_english, pr.product_id
),
ranked AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY category
                                 ORDER BY revenue DESC NULLS LAST, product_id) AS rn
    FROM product_revenue
)""", """
SELECT product_id, category, CAST(revenue AS DOUBLE) AS revenue
FROM ranked
WHERE rn = 1
ORDER BY revenue DESC"""),
}


def oracle_statements(prelude: bool = True) -> dict[str, str]:
    """Statements over the raw generated tables (with the adapter prelude), or, with
    ``prelude=False``, over logical tables registered as ``m_customers`` ... ``m_payments``."""
    return {
        name: _with_prelude(ctes, body, prelude) for name, (ctes, body) in STATEMENTS.items()
    }
