"""Profiling and exploration operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sales import PURCHASE_TS, parse_timestamps, period_predicate


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """``head(n)`` with an explicit order -- Spark rows have no position.

    Sorting on every column makes the chosen rows deterministic; the plan is a
    TakeOrderedAndProject that keeps n rows per task.
    """
    keys = order_by or df.columns
    return df.orderBy(*[F.asc_nulls_first(c) for c in keys]).limit(n)


def order_status_share(orders: DataFrame, year: int) -> DataFrame:
    """Share of each status among the year's orders, all statuses.

    Reads the raw orders table, ignores any selected month and divides by the non-missing
    status count (S13).  Sorted by share descending, status ascending on ties.
    """
    o = parse_timestamps(orders.select("order_status", PURCHASE_TS)).withColumn(
        "year", F.year(PURCHASE_TS)
    )
    counts = (
        o.where(period_predicate(year, None, PURCHASE_TS))
        .where(F.col("order_status").isNotNull())
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(
        "order_status", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share")
    ).orderBy(F.desc("share"), F.asc("order_status"))


def product_profile(products: DataFrame) -> DataFrame:
    """Distinct product ids and distinct non-missing categories."""
    return products.agg(
        F.count_distinct("product_id").alias("n_products"),
        F.count_distinct("product_category_name").alias("n_categories"),
    )


def distinct_values(df: DataFrame, column: str, descending: bool = False, keep_missing: bool = True) -> DataFrame:
    """``unique()`` of a column (A18).  Missing is a value of its own unless dropped;
    the order is explicit (ascending, missing first) instead of first-seen."""
    out = df.select(column)
    if not keep_missing:
        out = out.where(F.col(column).isNotNull())
    out = out.distinct()
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_first(column)
    return out.orderBy(order)


def available_years(sales: DataFrame) -> DataFrame:
    """Years present in the sales, newest first (A18, dashboard selector)."""
    return distinct_values(sales, "year", descending=True, keep_missing=False)


def sales_date_range(sales: DataFrame) -> DataFrame:
    """First and last purchase date of the sales."""
    return sales.agg(
        F.to_date(F.min(PURCHASE_TS)).alias("first_purchase_date"),
        F.to_date(F.max(PURCHASE_TS)).alias("last_purchase_date"),
    )


def period_counts(sales: DataFrame, current, previous) -> DataFrame:
    """Line items and distinct orders of two periods in one pass.

    Grouping by (period, order_id) first makes the order count a plain count and lets a
    hot order collapse map-side.
    """
    flagged = sales.where(current | previous).withColumn(
        "is_current", F.when(current, F.lit(True)).otherwise(F.lit(False))
    )
    items = F.count(F.lit(1)) if "n_items" not in sales.columns else F.sum("n_items")
    per_order = flagged.groupBy("is_current", "order_id").agg(items.alias("items"))
    cur = F.col("is_current")
    return per_order.agg(
        F.coalesce(F.sum(F.when(cur, F.col("items"))), F.lit(0)).alias("items"),
        F.count(F.when(cur & F.col("order_id").isNotNull(), F.lit(1))).alias("orders"),
        F.coalesce(F.sum(F.when(~cur, F.col("items"))), F.lit(0)).alias("prev_items"),
        F.count(F.when(~cur & F.col("order_id").isNotNull(), F.lit(1))).alias("prev_orders"),
    )
