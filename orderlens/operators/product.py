"""Product-category revenue (A7, A17, T1, T2, W2) and geography.

Both joins bring a dimension onto a fact that is orders of magnitude larger.  Instead of
joining every line item, the fact is first reduced to one row per dimension key
(``product_id`` / ``customer_id``) with map-side partial aggregation, and only that reduced
frame is joined and grouped again.  A sum over the join is a sum over dimension rows of the
per-key sums, so inner-join fan-out (duplicate dimension rows, S15) is kept exactly.
Whether the dimension side is broadcast is left to the planner's size estimate and AQE's
runtime statistics rather than a blind hint: at 100 TB neither table is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DELIVERED_STATUS, money_total, money_units_sql, units_sum
from .joins import count_equal_rows, join_pairing_missing
from .sales import PURCHASE_TS, parse_timestamps, price_units


def _revenue_by_key(sales: DataFrame, key: str, keep_missing: bool = False) -> DataFrame:
    return (
        (sales if keep_missing else sales.where(F.col(key).isNotNull()))
        .groupBy(key)
        .agg(units_sum(price_units(sales)).alias("key_revenue"))
    )


def _to_dimension(per_key: DataFrame, dimension: DataFrame, key: str, pair_missing: bool) -> DataFrame:
    """``key_revenue`` brought to the rows of a dimension; with ``pair_missing`` the one total of a
    missing key meets the dimension's rows without a key, equal ones counted first (S16)."""
    if not pair_missing:
        return per_key.join(dimension, key)
    joined = join_pairing_missing(count_equal_rows(dimension), per_key, key)
    return joined.withColumn("key_revenue", F.expr("CAST(key_revenue * n_rows AS decimal(38,0))")).drop("n_rows")


def revenue_by_category(sales: DataFrame, products: DataFrame, pair_missing: bool = False) -> DataFrame:
    """``product_category_name, revenue`` sorted by revenue descending, category ascending
    on ties (A7, S18).  Missing categories are dropped (S2).  ``pair_missing`` lets a missing
    product id match a missing one, as pandas' merge does (S16)."""
    per_product = _revenue_by_key(sales, "product_id", pair_missing)
    cats = products.select("product_id", "product_category_name").where(
        F.col("product_category_name").isNotNull()
    )
    return (
        _to_dimension(per_product, cats, "product_id", pair_missing)
        .groupBy("product_category_name")
        .agg(money_total("key_revenue").alias("revenue"))
        .orderBy(F.desc("revenue"), F.asc("product_category_name"))
    )


def top_n(ranked: DataFrame, n: int, value: str, key: str, ascending_output: bool = False, with_rank: bool = False) -> DataFrame:
    """First ``n`` rows by ``value`` descending, ``key`` ascending on ties.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its own top n,
    only n rows per task reach the final merge.  The rank (W2) is numbered on those n rows.
    """
    top = ranked.orderBy(F.desc(value), F.asc(key)).limit(n)
    if with_rank:
        w = Window.orderBy(F.desc(value), F.asc(key))
        top = top.select(F.row_number().over(w).alias("rank"), *ranked.columns)
    if ascending_output:
        top = top.orderBy(F.asc(value), F.desc(key))
    return top


def category_count(category_revenue: DataFrame) -> DataFrame:
    """Number of categories with sales, ``len(category_revenue)``."""
    return category_revenue.agg(F.count(F.lit(1)).alias("categories_with_sales"))


def revenue_by_state(
    sales: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    assume_unique_orders: bool = False,
    pair_missing: bool = False,
) -> DataFrame:
    """``customer_state, price`` (revenue) sorted descending, state ascending on ties.

    Sales are joined back to orders for ``customer_id`` as in the reference (J3), so
    duplicate orders rows fan out the same way; revenue is reduced to one row per customer
    before the customers join (J4).

    ``assume_unique_orders=True`` (R4) takes ``customer_id`` from the sales frame itself
    (``build_order_sales(carry_customer=True)``) and skips the join back to orders -- one
    shuffle of the orders table less.  Equal to the default only when every order id occurs
    once in orders; with repeated ids the default fans out to each repeat's customer.

    ``pair_missing`` lets missing order and customer ids match missing ones, as pandas' merge
    does (S16).
    """
    if assume_unique_orders and pair_missing:
        raise ValueError("missing order ids that match each other are not unique")
    if assume_unique_orders:
        if "customer_id" not in sales.columns:
            raise ValueError("sales carry no customer_id; build them with carry_customer=True")
        return _state_revenue_from_customers(_revenue_by_key(sales, "customer_id"), customers)
    per_order = _revenue_by_key(sales, "order_id", pair_missing)
    return state_revenue_from_orders(per_order, orders, customers, pair_missing)


def state_revenue_from_orders(
    per_order: DataFrame, orders: DataFrame, customers: DataFrame, pair_missing: bool = False
) -> DataFrame:
    """State revenue from ``order_id, key_revenue`` (exact units per order id)."""
    owners = orders.select("order_id", "customer_id")
    if not pair_missing:
        owners = owners.where(F.col("customer_id").isNotNull())
    per_customer = (
        _to_dimension(per_order, owners, "order_id", pair_missing)
        .groupBy("customer_id")
        .agg(F.sum("key_revenue").alias("key_revenue"))
    )
    return _state_revenue_from_customers(per_customer, customers, pair_missing)


def build_customer_sales(order_sales: DataFrame, orders: DataFrame) -> DataFrame:
    """``customer_id, price_units, year, month``: sales at customer grain, the fact that state
    revenue of stored facts reads.

    Every orders row of an order id is an owner of the order's sales, whatever its period and
    status (S15), so the join back to orders (J3) is made here once.  A period is a sum of its
    months, as a sale belongs to the month of its own orders row.
    """
    per_order = (
        order_sales.where(F.col("order_id").isNotNull())
        .groupBy("order_id", "year", "month")
        .agg(units_sum("price_units").alias("order_units"))
    )
    owners = orders.select("order_id", "customer_id").where(F.col("customer_id").isNotNull())
    return (
        per_order.join(owners, "order_id")
        .groupBy("customer_id", "year", "month")
        .agg(F.sum("order_units").alias("price_units"))
        .select("customer_id", "price_units", "year", "month")
    )


def state_revenue_from_customer_sales(customer_sales: DataFrame, customers: DataFrame) -> DataFrame:
    """State revenue of the months in ``customer_sales`` (see :func:`build_customer_sales`)."""
    per_customer = customer_sales.groupBy("customer_id").agg(F.sum("price_units").alias("key_revenue"))
    return _state_revenue_from_customers(per_customer, customers)


def state_revenue_of_period(
    order_items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    period: Column,
    status: str | None = DELIVERED_STATUS,
    lenient: bool = False,
) -> DataFrame:
    """``revenue_by_state`` of a period straight from the tables, with one scan of each.

    Owners come from every orders row of an order id, sales only from the rows of the period
    (S15), so the orders table is read once without the period filter and reduced to one row
    per (order, customer) with two counts: all rows, and rows that are sales of the period.
    ``period`` is a predicate over ``year``, ``month`` and the purchase timestamp.
    """
    rows = parse_timestamps(orders.select("order_id", "customer_id", "order_status", PURCHASE_TS), lenient=lenient)
    rows = rows.withColumn("year", F.year(PURCHASE_TS)).withColumn("month", F.month(PURCHASE_TS))
    sale = period if status is None else period & (F.col("order_status") == status)
    cells = (
        rows.where(F.col("order_id").isNotNull())
        .groupBy("order_id", "customer_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(sale, 1)).alias("n_sales"))
        .withColumn("n_sales", F.sum("n_sales").over(Window.partitionBy("order_id")))
        .where((F.col("n_sales") > 0) & F.col("customer_id").isNotNull())
    )
    totals = order_items.groupBy("order_id").agg(units_sum(money_units_sql("price")).alias("units"))
    per_customer = (
        totals.join(cells, "order_id")
        .groupBy("customer_id")
        .agg(F.expr("sum(units * n_sales * n_rows)").alias("key_revenue"))
    )
    return _state_revenue_from_customers(per_customer, customers)


def _state_revenue_from_customers(
    per_customer: DataFrame, customers: DataFrame, pair_missing: bool = False
) -> DataFrame:
    states = customers.select("customer_id", "customer_state").where(F.col("customer_state").isNotNull())
    return (
        _to_dimension(per_customer, states, "customer_id", pair_missing)
        .groupBy("customer_state")
        .agg(money_total("key_revenue").alias("price"))
        .orderBy(F.desc("price"), F.asc("customer_state"))
    )


def state_scale_labels(state_revenue: DataFrame) -> DataFrame:
    """The map's colour-bar ticks as rows ``tick, value, label`` -- minimum, midpoint and
    maximum state revenue with their currency labels (A21, F1)."""
    from ..functions.columns import currency_label

    scale = state_revenue_scale(state_revenue)
    ticks = F.array(
        F.struct(F.lit("min").alias("tick"), F.col("rev_min").alias("value")),
        F.struct(F.lit("mid").alias("tick"), F.col("rev_mid").alias("value")),
        F.struct(F.lit("max").alias("tick"), F.col("rev_max").alias("value")),
    )
    return scale.select(F.inline(ticks)).withColumn("label", currency_label("value"))


def state_revenue_scale(state_revenue: DataFrame) -> DataFrame:
    """Colour-scale ticks of the state map: ``rev_min, rev_mid, rev_max``."""
    return state_revenue.agg(F.min("price").alias("rev_min"), F.max("price").alias("rev_max")).select(
        "rev_min", ((F.col("rev_min") + F.col("rev_max")) / 2).alias("rev_mid"), "rev_max"
    )
