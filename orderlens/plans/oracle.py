"""DuckDB oracle text for every registered query (``__spark_entry__.oracle_sql``).

Each statement starts from the driver's raw tables, rebuilds the fixture views and the
delivered-sales fact as CTEs, and computes the metric the plain relational way (line grain,
no pre-aggregation), so it checks the Spark plans' rewrites as well as their values.
Money is summed as DECIMAL(18,2) and returned as DOUBLE in both engines; ``year()`` and
``month()`` are cast to INTEGER (BIGINT in DuckDB, INT in Spark).
"""

from __future__ import annotations

from ..sources.fixtures import FIXTURE_SQL_DUCKDB
from .catalog import MONTH, PARTIAL_YEAR, YEAR

SALES_CTE = """
sales AS (
  SELECT i.order_id, i.order_item_id, i.product_id, i.price, o.order_status,
         o.order_purchase_timestamp, o.order_delivered_customer_date,
         CAST(month(o.order_purchase_timestamp) AS INTEGER) AS month,
         CAST(year(o.order_purchase_timestamp) AS INTEGER) AS year
  FROM fx_items i JOIN fx_orders o ON i.order_id = o.order_id
  WHERE o.order_status = 'delivered')"""

DELIVERY_DAYS = (
    "CAST(floor((epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp))"
    " / 86400000000.0) AS INTEGER)"
)


def _bucket(days: str) -> str:
    return (
        f"CASE WHEN {days} <= 3 THEN '1-3 days' WHEN {days} <= 7 THEN '4-7 days' "
        "ELSE '8+ days' END"
    )


def _money(expr: str) -> str:
    return f"CAST(coalesce(sum(CAST({expr} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def _currency(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 1000000 THEN '$' || format('{{:.1f}}', {x} / 1000000) || 'M' "
        f"WHEN {x} >= 1000 THEN '$' || format('{{:.0f}}', {x} / 1000) || 'K' "
        f"WHEN {x} IS NOT NULL THEN '$' || format('{{:.0f}}', {x}) END"
    )


def _guarded(cur: str, prev: str) -> str:
    return (
        f"CASE WHEN CAST({prev} AS DOUBLE) > 0 THEN "
        f"(CAST({cur} AS DOUBLE) - CAST({prev} AS DOUBLE)) / CAST({prev} AS DOUBLE) ELSE 0.0 END"
    )


def _growth(cur: str, prev: str) -> str:
    return f"(CAST({cur} AS DOUBLE) - CAST({prev} AS DOUBLE)) / NULLIF(CAST({prev} AS DOUBLE), 0)"


def _trend(g: str, prefix: str, inverted: bool = False) -> str:
    good = f"NOT ({g} * 100 >= 0)" if inverted else f"({g} * 100 >= 0)"
    return (
        f"CASE WHEN {g} * 100 >= 0 THEN 'up' WHEN {g} IS NOT NULL THEN 'down' END AS {prefix}trend_dir, "
        f"{good} AS {prefix}trend_good, "
        f"format('{{:.2f}}', abs({g} * 100)) AS {prefix}trend_pct"
    )


def _label(year: str, month: str) -> str:
    return (
        f"CASE WHEN {month} IS NULL THEN CAST({year} AS VARCHAR) "
        f"ELSE strftime(make_date(2020, {month}, 1), '%B') || ' ' || CAST({year} AS VARCHAR) END"
    )


def _period(year: int, month: int | None) -> str:
    cond = f"year = {year}"
    if month is not None:
        cond += f" AND month = {month}"
    return cond


def _with(*ctes: str) -> str:
    parts = [FIXTURE_SQL_DUCKDB.strip(), SALES_CTE.strip(), *[c.strip() for c in ctes]]
    return "WITH " + ",\n".join(parts) + "\n"


def _delivery_cte(name: str, where: str) -> str:
    return (
        f"{name} AS (SELECT *, {DELIVERY_DAYS} AS delivery_speed, {_bucket(DELIVERY_DAYS)} AS delivery_time "
        f"FROM sales WHERE {where})"
    )


def _review_cte(year: int = YEAR, month: int | None = None) -> tuple[str, str]:
    sd = _delivery_cte("sd", _period(year, month))
    rs = (
        "rs AS (SELECT DISTINCT sd.order_id, sd.delivery_speed, sd.delivery_time, r.review_score "
        "FROM sd JOIN fx_reviews r ON sd.order_id = r.order_id)"
    )
    return sd, rs


def _comparison_cte(year: int, month: int | None, cmp_year: int) -> str:
    cur, prev = _period(year, month), _period(cmp_year, month)
    return f"""
cmp AS (
  SELECT {_money(f"CASE WHEN {cur} THEN price END")} AS revenue,
         {_money(f"CASE WHEN {prev} THEN price END")} AS prev_revenue,
         count(DISTINCT CASE WHEN {cur} THEN order_id END) AS order_count,
         count(DISTINCT CASE WHEN {prev} THEN order_id END) AS prev_order_count
  FROM sales WHERE ({cur}) OR ({prev})),
cmp2 AS (
  SELECT *, revenue / NULLIF(CAST(order_count AS DOUBLE), 0) AS aov,
         prev_revenue / NULLIF(CAST(prev_order_count AS DOUBLE), 0) AS prev_aov FROM cmp)"""


def _experience_cte(year: int, month: int | None, cmp_year: int) -> str:
    cur, prev = _period(year, month), _period(cmp_year, month)
    return f"""
xd AS (SELECT *, {DELIVERY_DAYS} AS delivery_speed, {_bucket(DELIVERY_DAYS)} AS delivery_time,
              ({cur}) AS is_current
       FROM sales WHERE ({cur}) OR ({prev})),
xr AS (SELECT DISTINCT xd.is_current, xd.order_id, xd.delivery_speed, xd.delivery_time, r.review_score
       FROM xd JOIN fx_reviews r ON xd.order_id = r.order_id),
xp AS (SELECT avg(CASE WHEN is_current THEN review_score END) AS avg_score,
              avg(CASE WHEN is_current THEN delivery_speed END) AS avg_delivery_days,
              avg(CASE WHEN NOT is_current THEN delivery_speed END) AS prev_avg_delivery_days
       FROM xr)"""


def _monthly_growth_cte(year: int) -> str:
    return f"""
mr AS (SELECT month, {_money("price")} AS revenue FROM sales
       WHERE {_period(year, None)} AND month IS NOT NULL GROUP BY month),
mg AS (SELECT month, revenue,
              (revenue - lag(revenue) OVER (ORDER BY month))
                / NULLIF(lag(revenue) OVER (ORDER BY month), 0) AS growth FROM mr)"""


def _kpi(year: int, month: int | None) -> str:
    cmp_year = year - 1
    ctes = [_comparison_cte(year, month, cmp_year), _experience_cte(year, month, cmp_year)]
    if month is None:
        ctes.append(_monthly_growth_cte(year))
        mom = "(SELECT CASE WHEN count(growth) = count(*) - 1 THEN avg(growth) END FROM mg)"
    else:
        mom = "CAST(NULL AS DOUBLE)"
    month_sql = "CAST(NULL AS INTEGER)" if month is None else f"CAST({month} AS INTEGER)"
    return _with(*ctes) + f"""
, k AS (
  SELECT {year} AS year, {month_sql} AS month, {cmp_year} AS comparison_year,
         {_label(str(year), month_sql)} AS period_label,
         revenue, prev_revenue, {_guarded("revenue", "prev_revenue")} AS revenue_growth,
         aov, prev_aov, {_guarded("aov", "prev_aov")} AS aov_growth,
         order_count, prev_order_count, {_guarded("order_count", "prev_order_count")} AS order_growth,
         {mom} AS avg_monthly_growth,
         avg_delivery_days, prev_avg_delivery_days,
         {_guarded("avg_delivery_days", "prev_avg_delivery_days")} AS delivery_growth,
         avg_score
  FROM cmp2, xp)
SELECT *, CAST(format('{{:.2f}}', avg_score) AS DOUBLE) AS avg_score_rounded,
       {_currency("revenue")} AS revenue_label, {_currency("aov")} AS aov_label,
       {_trend("revenue_growth", "revenue_")}, {_trend("aov_growth", "aov_")},
       {_trend("order_growth", "order_")}, {_trend("delivery_growth", "delivery_", inverted=True)}
FROM k"""


def _summary(year: int, month: int | None) -> str:
    cmp_year = year - 1
    cur = _period(year, month)
    month_sql = "CAST(NULL AS INTEGER)" if month is None else f"CAST({month} AS INTEGER)"
    return _with(_comparison_cte(year, month, cmp_year), _experience_cte(year, month, cmp_year)) + f"""
, cat AS (SELECT p.product_category_name, sum(CAST(s.price AS DECIMAL(18,2))) AS rev
          FROM sales s JOIN fx_products p ON s.product_id = p.product_id
          WHERE {cur.replace("year", "s.year").replace("month", "s.month")}
            AND p.product_category_name IS NOT NULL GROUP BY 1),
st AS (SELECT c.customer_state, sum(CAST(s.price AS DECIMAL(18,2))) AS rev
       FROM sales s JOIN fx_orders o ON s.order_id = o.order_id
       JOIN fx_customers c ON o.customer_id = c.customer_id
       WHERE {cur.replace("year", "s.year").replace("month", "s.month")} GROUP BY 1)
SELECT {year} AS year, {month_sql} AS month, {cmp_year} AS comparison_year,
       {_label(str(year), month_sql)} AS period_label,
       revenue, {_growth("revenue", "prev_revenue")} AS revenue_growth,
       aov, {_growth("aov", "prev_aov")} AS aov_growth,
       order_count, {_growth("order_count", "prev_order_count")} AS order_growth,
       (SELECT product_category_name FROM cat ORDER BY rev DESC, product_category_name LIMIT 1) AS top_category,
       (SELECT customer_state FROM st ORDER BY rev DESC, customer_state LIMIT 1) AS top_state,
       avg_delivery_days, avg_score
FROM cmp2, xp"""


def _describe() -> str:
    def one(col: str, mean: str) -> str:
        return (
            f"SELECT '{col}' AS column, count({col}) AS count, {mean} AS mean, "
            f"stddev_samp(CAST({col} AS DOUBLE)) AS std, min(CAST({col} AS DOUBLE)) AS min, "
            f"quantile_cont(CAST({col} AS DOUBLE), 0.25) AS p25, "
            f"quantile_cont(CAST({col} AS DOUBLE), 0.5) AS p50, "
            f"quantile_cont(CAST({col} AS DOUBLE), 0.75) AS p75, "
            f"max(CAST({col} AS DOUBLE)) AS max FROM fx_items"
        )

    def int_mean(col: str) -> str:
        return f"CAST(sum(CAST({col} AS DECIMAL(38,0))) AS DOUBLE) / NULLIF(CAST(count({col}) AS DOUBLE), 0)"

    money_mean = "CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(count(price) AS DOUBLE), 0)"
    body = "\nUNION ALL\n".join(
        [
            one("order_id", int_mean("order_id")),
            one("order_item_id", int_mean("order_item_id")),
            one("product_id", int_mean("product_id")),
            one("price", money_mean),
        ]
    )
    return _with() + body


def _period_cube() -> str:
    return _with(
        f"""
pm AS (SELECT year, month, order_id, sum(CAST(price AS DECIMAL(18,2))) AS r FROM sales
       WHERE year IS NOT NULL GROUP BY year, month, order_id),
py AS (SELECT year, order_id, sum(CAST(price AS DECIMAL(18,2))) AS r FROM sales
       WHERE year IS NOT NULL GROUP BY year, order_id),
cells AS (
  SELECT year, month, sum(r) AS rev, count(*) AS order_count FROM pm GROUP BY year, month
  UNION ALL
  SELECT year, CAST(NULL AS INTEGER) AS month, sum(r) AS rev, count(*) AS order_count FROM py GROUP BY year),
c2 AS (SELECT year, month, CAST(rev AS DOUBLE) AS revenue, order_count,
              CAST(rev AS DOUBLE) / NULLIF(CAST(order_count AS DOUBLE), 0) AS aov FROM cells)"""
    ) + f"""
SELECT c.year, c.month, {_label("c.year", "c.month")} AS period_label,
       c.revenue, c.order_count, c.aov,
       {_guarded("c.revenue", "p.revenue")} AS revenue_growth,
       {_guarded("c.aov", "p.aov")} AS aov_growth,
       {_guarded("c.order_count", "p.order_count")} AS order_growth,
       {_currency("c.revenue")} AS revenue_label, {_currency("c.aov")} AS aov_label
FROM c2 c LEFT JOIN c2 p ON c.year = p.year + 1 AND c.month IS NOT DISTINCT FROM p.month"""


def _category_cte(year: int, month: int | None = None) -> str:
    cond = _period(year, month).replace("year", "s.year").replace("month", "s.month")
    return f"""
cat AS (SELECT p.product_category_name, {_money("s.price")} AS revenue
        FROM sales s JOIN fx_products p ON s.product_id = p.product_id
        WHERE {cond} AND p.product_category_name IS NOT NULL GROUP BY 1)"""


def _state_cte(year: int, month: int | None = None) -> str:
    cond = _period(year, month).replace("year", "s.year").replace("month", "s.month")
    return f"""
st AS (SELECT c.customer_state, {_money("s.price")} AS price
       FROM sales s JOIN fx_orders o ON s.order_id = o.order_id
       JOIN fx_customers c ON o.customer_id = c.customer_id
       WHERE {cond} GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    y, py, m = YEAR, YEAR - 1, MONTH
    sd, rs = _review_cte()
    sales_cols = (
        "order_id, order_item_id, product_id, price, order_status, order_purchase_timestamp, "
        "order_delivered_customer_date, month, year"
    )
    preview_order = ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in sales_cols.split(","))
    both = f"({_period(y, None)}) OR ({_period(py, None)})"
    out = {
        "scan_counts": _with()
        + " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {view}"
            for name, view in [
                ("orders", "fx_orders"),
                ("order_items", "fx_items"),
                ("products", "fx_products"),
                ("customers", "fx_customers"),
                ("reviews", "fx_reviews"),
            ]
        ),
        "sales_base": _with() + f"SELECT {sales_cols} FROM sales",
        "sales_period_year": _with() + f"SELECT {sales_cols} FROM sales WHERE {_period(y, None)}",
        "sales_period_month": _with() + f"SELECT {sales_cols} FROM sales WHERE {_period(y, m)}",
        "delivery_metrics": _with(_delivery_cte("sd", "TRUE")) + f"SELECT {sales_cols}, delivery_speed, delivery_time FROM sd",
        "preview_sales": _with() + f"SELECT {sales_cols} FROM sales ORDER BY {preview_order} LIMIT 5",
        "total_revenue": _with() + f"SELECT {_money('price')} AS revenue FROM sales WHERE {_period(y, None)}",
        "monthly_revenue": _with()
        + f"SELECT month, {_money('price')} AS revenue FROM sales WHERE {_period(y, None)} AND month IS NOT NULL GROUP BY month",
        "revenue_year_month": _with()
        + f"SELECT year, month, {_money('price')} AS revenue FROM sales WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month",
        "monthly_growth": _with(_monthly_growth_cte(y)) + "SELECT month, revenue, growth FROM mg",
        "avg_monthly_growth": _with(_monthly_growth_cte(y)) + "SELECT CASE WHEN count(growth) = count(*) - 1 THEN avg(growth) END AS avg_monthly_growth FROM mg",
        "aov": _with()
        + f"SELECT CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(count(DISTINCT order_id) AS DOUBLE), 0) AS aov FROM sales WHERE {_period(y, None)}",
        "order_count": _with() + f"SELECT count(DISTINCT order_id) AS order_count FROM sales WHERE {_period(y, None)}",
        "revenue_growth": _with(_comparison_cte(y, None, py))
        + f"SELECT revenue, prev_revenue, {_growth('revenue', 'prev_revenue')} AS revenue_growth FROM cmp2",
        "aov_growth": _with(_comparison_cte(y, None, py))
        + f"SELECT aov, prev_aov, {_growth('aov', 'prev_aov')} AS aov_growth FROM cmp2",
        "order_count_growth": _with(_comparison_cte(y, None, py))
        + f"SELECT order_count, prev_order_count, {_growth('order_count', 'prev_order_count')} AS order_count_growth FROM cmp2",
        "period_counts": _with()
        + f"""SELECT count(*) FILTER (WHERE {_period(y, None)}) AS items,
                   count(DISTINCT CASE WHEN {_period(y, None)} THEN order_id END) AS orders,
                   count(*) FILTER (WHERE {_period(py, None)}) AS prev_items,
                   count(DISTINCT CASE WHEN {_period(py, None)} THEN order_id END) AS prev_orders
            FROM sales WHERE {both}""",
        "revenue_by_category": _with(_category_cte(y)) + "SELECT product_category_name, revenue FROM cat",
        "revenue_by_category_month": _with(_category_cte(y, m)) + "SELECT product_category_name, revenue FROM cat",
        "revenue_by_state_month": _with(_state_cte(y, m)) + "SELECT customer_state, price FROM st",
        "categories_with_sales": _with(_category_cte(y)) + "SELECT count(*) AS categories_with_sales FROM cat",
        "top_categories_10": _with(_category_cte(y))
        + f"SELECT product_category_name, revenue, {_currency('revenue')} AS label FROM cat ORDER BY revenue DESC, product_category_name LIMIT 10",
        "top_categories_15": _with(_category_cte(y))
        + f"""SELECT CAST(row_number() OVER (ORDER BY revenue DESC, product_category_name) AS INTEGER) AS rank,
                     product_category_name, revenue, {_currency('revenue')} AS label
              FROM cat ORDER BY revenue DESC, product_category_name LIMIT 15""",
        "revenue_by_state": _with(_state_cte(y)) + "SELECT customer_state, price FROM st",
        "top_states_10": _with(_state_cte(y)) + "SELECT customer_state, price FROM st ORDER BY price DESC, customer_state LIMIT 10",
        "state_revenue_scale": _with(_state_cte(y))
        + "SELECT min(price) AS rev_min, (min(price) + max(price)) / 2 AS rev_mid, max(price) AS rev_max FROM st",
        "revenue_labels": _with(_state_cte(y))
        + f""", sc AS (SELECT min(price) AS rev_min, (min(price) + max(price)) / 2 AS rev_mid, max(price) AS rev_max FROM st),
              tk AS (SELECT 'min' AS tick, rev_min AS value FROM sc UNION ALL SELECT 'mid', rev_mid FROM sc
                     UNION ALL SELECT 'max', rev_max FROM sc)
              SELECT tick, value, {_currency('value')} AS label FROM tk""",
        "review_speed": _with(sd, rs) + "SELECT order_id, delivery_speed, delivery_time, review_score FROM rs",
        "review_summary": _with(sd, rs)
        + "SELECT avg(review_score) AS avg_score, avg(delivery_speed) AS avg_delivery_speed FROM rs",
        "review_summary_month": _with(*_review_cte(y, m))
        + "SELECT avg(review_score) AS avg_score, avg(delivery_speed) AS avg_delivery_speed FROM rs",
        "score_distribution": _with(sd, rs)
        + """SELECT review_score, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share,
                    CAST(review_score AS VARCHAR) || ' star' || CASE WHEN review_score > 1 THEN 's' ELSE '' END AS label
             FROM rs WHERE review_score IS NOT NULL GROUP BY review_score""",
        "score_by_bucket": _with(sd, rs)
        + """SELECT delivery_time, avg(review_score) AS review_score,
                    CASE delivery_time WHEN '1-3 days' THEN 1 WHEN '4-7 days' THEN 2 WHEN '8+ days' THEN 3 END AS bucket_ord
             FROM rs GROUP BY delivery_time""",
        "score_by_delivery_day": _with(sd, rs)
        + "SELECT delivery_speed, avg(review_score) AS review_score FROM rs WHERE delivery_speed IS NOT NULL GROUP BY delivery_speed",
        "order_status_share": _with()
        + f"""SELECT order_status, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
              FROM fx_orders WHERE CAST(year(order_purchase_timestamp) AS INTEGER) = {y} AND order_status IS NOT NULL
              GROUP BY order_status""",
        "product_profile": _with()
        + "SELECT count(DISTINCT product_id) AS n_products, count(DISTINCT product_category_name) AS n_categories FROM fx_products",
        "distinct_categories": _with() + "SELECT DISTINCT product_category_name FROM fx_products",
        "distinct_statuses": _with() + "SELECT DISTINCT order_status FROM fx_orders",
        "available_years": _with() + "SELECT DISTINCT year FROM sales WHERE year IS NOT NULL",
        "sales_date_range": _with()
        + "SELECT CAST(min(order_purchase_timestamp) AS DATE) AS first_purchase_date, CAST(max(order_purchase_timestamp) AS DATE) AS last_purchase_date FROM sales",
        "describe_items": _describe(),
        "kpi_report": _kpi(y, None),
        "kpi_report_month": _kpi(y, m),
        "kpi_report_partial_year": _kpi(PARTIAL_YEAR, None),
        "monthly_trend": _with(
            f"""
mt AS (SELECT month, sum(CASE WHEN year = {PARTIAL_YEAR} THEN CAST(price AS DECIMAL(18,2)) END) AS cur,
              sum(CASE WHEN year = {PARTIAL_YEAR - 1} THEN CAST(price AS DECIMAL(18,2)) END) AS prev
       FROM sales WHERE year IN ({PARTIAL_YEAR}, {PARTIAL_YEAR - 1}) GROUP BY month),
grid AS (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13))"""
        )
        + """SELECT g.month, strftime(make_date(2020, g.month, 1), '%b') AS month_name,
                    CAST(coalesce(mt.cur, 0) AS DOUBLE) AS revenue, CAST(coalesce(mt.prev, 0) AS DOUBLE) AS prev_revenue
             FROM grid g LEFT JOIN mt ON g.month = mt.month""",
        "monthly_growth_report": _with(_monthly_growth_cte(y))
        + """SELECT CAST(month AS INTEGER) AS month, strftime(make_date(2020, month, 1), '%B') AS month_name, growth FROM mg
             UNION ALL SELECT CAST(NULL AS INTEGER), 'Average', CASE WHEN count(growth) = count(*) - 1 THEN avg(growth) END FROM mg""",
        "summary": _summary(y, None),
        "summary_month": _summary(y, m),
        "period_cube": _period_cube(),
        "order_count_sketches": f"SELECT year, month, order_count, TRUE AS within_bound FROM ({_period_cube()}) AS cube",
    }
    # other ways to the same results
    for name, same in {
        "revenue_by_state_stored": "revenue_by_state",
        "revenue_by_state_month_stored": "revenue_by_state_month",
        "summary_month_refreshed": "summary_month",
        "period_cube_refreshed": "period_cube",
        "kpi_report_bucketed": "kpi_report",
        "kpi_report_double_scores": "kpi_report",
        "summary_double_scores": "summary",
    }.items():
        out[name] = out[same]
    return out
