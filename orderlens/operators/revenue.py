"""Revenue and order metrics.

Every function takes an already filtered sales DataFrame (line grain or order grain, see
``operators.sales``) and returns a lazy DataFrame; a scalar metric is a one-row DataFrame.
Metrics never filter by period themselves, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import growth, money_total, money_total_sql, safe_ratio, safe_ratio_sql, units_sum, units_to_money_sql, wide_sum_sql
from .sales import price_units


# The previous month present in the (at most twelve) monthly rows.
PREVIOUS_MONTH = "lag(revenue) OVER (ORDER BY month)"
# Mean of the growths of monthly rows.  Only the first month may lack a growth; where a month
# follows a zero month its growth is undefined (NULL), and so is the mean.
MEAN_GROWTH = "CASE WHEN count(growth) = count(*) - 1 THEN avg(growth) END"


def total_revenue(sales: DataFrame) -> DataFrame:
    """Sum of prices; no rows give 0.0."""
    return sales.agg(money_total(price_units(sales)).alias("revenue"))


def _monthly(sales: DataFrame) -> DataFrame:
    revenue = money_total(price_units(sales)).alias("revenue")
    return sales.where(F.col("month").isNotNull()).groupBy("month").agg(revenue)


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per month number present in the data (A2).  Missing months are dropped as
    pandas drops a missing group key (S2)."""
    return _monthly(sales).orderBy("month")


def revenue_year_month(sales: DataFrame) -> DataFrame:
    """Revenue per (year, month) (A3)."""
    return (
        sales.where(F.col("year").isNotNull() & F.col("month").isNotNull())
        .groupBy("year", "month")
        .agg(money_total(price_units(sales)).alias("revenue"))
        .orderBy("year", "month")
    )


def monthly_growth(sales: DataFrame) -> DataFrame:
    """Month-over-month growth against the previous month *present* (W1, S8); the first
    month and a zero base give NULL (S9).

    The window runs over the monthly aggregate: at most twelve rows, so its single
    partition is bounded whatever the input size.
    """
    return _growth(sales).orderBy("month")


def _growth(sales: DataFrame) -> DataFrame:
    return _monthly(sales).withColumn("growth", growth("revenue", PREVIOUS_MONTH))


def avg_monthly_growth(sales: DataFrame) -> DataFrame:
    """Mean of the month-over-month growths (A6, S3); see ``MEAN_GROWTH``."""
    return _growth(sales).agg(F.expr(MEAN_GROWTH).alias("avg_monthly_growth"))


def avg_growth_of_months(monthly: DataFrame) -> DataFrame:
    """Mean month-over-month growth of ``month, revenue`` rows (at most twelve)."""
    g = monthly.withColumn("growth", growth("revenue", PREVIOUS_MONTH))
    return g.agg(F.expr(MEAN_GROWTH).alias("avg_monthly_growth"))


def aov(sales: DataFrame) -> DataFrame:
    """Average order value: mean over orders of the per-order revenue.

    The mean of per-order sums is the exact total divided by the number of orders; an order
    whose prices are all missing counts with 0.  ``count_distinct`` plans as a partial
    aggregation keyed by ``order_id`` -- the same shuffle that gives the order count.
    """
    total = money_total_sql(f"CASE WHEN order_id IS NOT NULL THEN {price_units(sales)} END")
    return sales.agg(F.expr(safe_ratio_sql(total, "count(DISTINCT order_id)")).alias("aov"))


def order_count(sales: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """Number of distinct orders; missing ids are ignored.

    Exact by default.  ``approx_rsd`` (e.g. 0.01) switches to HyperLogLog++
    (``approx_count_distinct``): one pass, no shuffle of order ids, for very large data.
    """
    if approx_rsd is not None:
        return sales.agg(F.approx_count_distinct("order_id", approx_rsd).alias("order_count"))
    return sales.agg(F.count_distinct("order_id").alias("order_count"))


# Size of the stored order sketches: 2**12 registers, 1.04 / 2**6 = 1.6 % standard error.
SKETCH_LG_K = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG_K / 2)


def build_order_cells(order_sales: DataFrame) -> DataFrame:
    """``revenue_units, order_sketch, year, month``: one row per month with its exact revenue
    and a distinct-count sketch of its order ids.

    Sketches merge (``hll_union_agg``), so the orders of any set of months come from a few
    kilobytes per month, an order present in several of them counted once.
    """
    sales = order_sales.where(F.col("order_id").isNotNull() & F.col("year").isNotNull())
    key = F.col("order_id")
    if dict(order_sales.dtypes)["order_id"] not in ("int", "bigint", "string", "binary"):
        key = key.cast("string")
    return sales.groupBy("year", "month").agg(
        F.expr(wide_sum_sql("price_units")).alias("revenue_units"),
        F.hll_sketch_agg(key, SKETCH_LG_K).alias("order_sketch"),
    ).select("revenue_units", "order_sketch", "year", "month")


def order_count_of_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """``keys..., revenue, order_count, aov`` of months put together: revenue exact, orders
    estimated within ``SKETCH_ERROR`` (one standard error; three hold in 99.7 % of cases)."""
    return (
        cells.groupBy(*keys)
        .agg(
            F.expr("sum(revenue_units)").alias("units"),
            F.hll_sketch_estimate(F.hll_union_agg("order_sketch")).alias("order_count"),
        )
        .select(
            *keys,
            F.expr(units_to_money_sql("units")).alias("revenue"),
            "order_count",
            F.expr(safe_ratio_sql(units_to_money_sql("units"), "order_count")).alias("aov"),
        )
    )


def per_order_totals(sales: DataFrame, *keys: str) -> DataFrame:
    """``keys..., order_id, order_revenue`` -- one row per order (and key), exact units.

    On an order-grain fact this aggregation reuses the ``order_id`` partitioning of the
    join below it and adds no exchange.
    """
    return (
        sales.where(F.col("order_id").isNotNull())
        .groupBy(*keys, "order_id")
        .agg(units_sum(price_units(sales)).alias("order_revenue"))
    )


def flag_periods(sales: DataFrame, current, previous) -> DataFrame:
    """Rows of either period with a boolean ``is_current``."""
    return sales.where(current | previous).withColumn(
        "is_current", F.when(current, F.lit(True)).otherwise(F.lit(False))
    )


def period_comparison(sales: DataFrame, current, previous) -> DataFrame:
    """Revenue, order count and AOV of two periods in one pass.

    ``current`` / ``previous`` are boolean Columns selecting each period's rows.  One
    per-order aggregation serves both periods; the result is one row with
    ``revenue, prev_revenue, order_count, prev_order_count, aov, prev_aov``.
    """
    return comparison_from_orders(per_order_totals(flag_periods(sales, current, previous), "is_current"))


def comparison_from_orders(per_order: DataFrame) -> DataFrame:
    """The two-period comparison from ``is_current, order_id, order_revenue`` rows."""
    agg = per_order.agg(
        money_total("CASE WHEN is_current THEN order_revenue END").alias("revenue"),
        money_total("CASE WHEN NOT is_current THEN order_revenue END").alias("prev_revenue"),
        F.expr("count(CASE WHEN is_current THEN 1 END)").alias("order_count"),
        F.expr("count(CASE WHEN NOT is_current THEN 1 END)").alias("prev_order_count"),
    )
    # Sales come from an inner equi-join on order_id, so no row lacks an order id
    # and the per-order totals add up to the whole revenue.
    return agg.select(
        "revenue",
        "prev_revenue",
        "order_count",
        "prev_order_count",
        safe_ratio("revenue", "order_count").alias("aov"),
        safe_ratio("prev_revenue", "prev_order_count").alias("prev_aov"),
    )
