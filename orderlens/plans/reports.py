"""End-product reports (P1-P4, F1-F3, R-1) composed from the operators.

Each report is one lazy Spark plan.  Scalars from independent branches are combined by
stacking one-row frames (``unionByName``) and collapsing them with one aggregate, so no
report needs a cross join.  Money is summed once per order at order grain; both periods of a
comparison come out of the same pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    currency_label,
    growth,
    guarded_growth,
    money_total,
    month_name,
    period_label,
    round_half_even,
    safe_ratio,
    safe_ratio_sql,
    score_label,
    trend_columns,
    units_to_money,
    units_to_money_sql,
    wide_sum_sql,
)
from ..operators.experience import (
    delivery_metrics,
    known_scores,
    review_speed,
    score_by_bucket,
    score_distribution,
)
from ..operators.product import (
    revenue_by_category,
    state_revenue_from_customer_sales,
    state_revenue_from_orders,
    state_revenue_of_period,
    top_n,
)
from ..operators.revenue import (
    MEAN_GROWTH,
    avg_growth_of_months,
    flag_periods,
    monthly_growth,
    order_count_of_cells,
    per_order_totals,
)
from ..operators.sales import filter_by_period, period_predicate, price_units
from .model import SalesModel


def collapse_rows(frames: list[DataFrame]) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row (no cross join)."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = []
    for frame in frames:
        cols.extend(c for c in frame.columns if c not in cols)
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def _label(year: int, month: int | None) -> Column:
    return period_label(str(int(year)), None if month is None else str(int(month)))


def _periods(year: int, month: int | None, comparison_year: int | None) -> tuple[Column, Column, int]:
    cmp_year = year - 1 if comparison_year is None else comparison_year
    return period_predicate(year, month), period_predicate(cmp_year, month), cmp_year


PERIOD_ORDER_KEYS = ("is_current", "month", "delivery_speed", "delivery_time")


def period_orders(model: SalesModel, current: Column, previous: Column) -> DataFrame:
    """``is_current, month, delivery_speed, delivery_time, order_id, order_revenue``: one row
    per order and period (per orders row, when an id repeats with other times).

    The single aggregation every two-period report branch starts from.  Its grouping keys
    are all functions of the orders row, so it reuses the order-grain fact's ``order_id``
    partitioning; branches regroup or select from it with conditional aggregates rather
    than filters, which keeps their plans identical below it so Spark reuses its exchanges.
    """
    flagged = delivery_metrics(flag_periods(model.order_sales, current, previous))
    return per_order_totals(flagged, *PERIOD_ORDER_KEYS)


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    """``order_id, n_reviews, n_scores, score_sum`` over an order's *distinct* scores (A9: equal
    scores collapse, a missing score counts as one more row).  The score set of an order is
    bounded by the scale, so one aggregation does it."""
    reviews = known_scores(reviews)
    # sums start from a value of the scores' kind: whole numbers stay exact longs
    whole = dict(reviews.dtypes)["review_score"] in ("tinyint", "smallint", "int", "bigint")
    start, kind = ("0L", "BIGINT") if whole else ("0D", "DOUBLE")
    sets = reviews.groupBy("order_id").agg(
        F.sort_array(F.collect_set("review_score")).alias("scores"), F.max(F.col("review_score").isNull()).alias("missing")
    )
    return sets.select(
        "order_id",
        F.expr("size(scores) + CASE WHEN missing THEN 1 ELSE 0 END").alias("n_reviews"),
        F.size("scores").alias("n_scores"),
        F.expr(f"aggregate(scores, {start}, (a, x) -> a + CAST(x AS {kind}))").alias("score_sum"),
    )


def comparison_of(model: SalesModel, orders_by_period: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Revenue, orders, AOV, review score and delivery days of both periods, from one chain
    of aggregations over ``period_orders`` rows; and its per-order rows.

    Reviews are reduced to one row per order and joined once.  All groupings hold
    ``order_id``, so the chain adds no shuffle to that of the facts and reviews.  A review row is
    one (period, order, delivery, score), so months collapse first; the delivery average
    weighs an order row by its reviews, as the review table does.
    """
    review = reviews_per_order(model.reviews)
    rows = orders_by_period.groupBy("is_current", "order_id", "delivery_speed", "delivery_time").agg(
        F.sum("order_revenue").alias("order_revenue")
    )
    per_order = (
        rows.join(review, "order_id", "left")
        .groupBy("is_current", "order_id")
        .agg(
            F.sum("order_revenue").alias("order_revenue"),
            F.sum("score_sum").alias("score_sum"),
            F.sum("n_scores").alias("n_scores"),
            F.expr("sum(CAST(delivery_speed AS BIGINT) * n_reviews)").alias("days_sum"),
            F.expr("sum(CASE WHEN delivery_speed IS NOT NULL THEN n_reviews END)").alias("n_days"),
        )
    )
    sums = []
    for flag, prefix in (("is_current", ""), ("NOT is_current", "prev_")):
        sums += [
            money_total(f"CASE WHEN {flag} THEN order_revenue END").alias(f"{prefix}revenue"),
            F.expr(f"count(CASE WHEN {flag} THEN 1 END)").alias(f"{prefix}order_count"),
        ]
        for name, total, count in (("avg_score", "score_sum", "n_scores"), ("avg_delivery_days", "days_sum", "n_days")):
            pick = [f"sum(CASE WHEN {flag} THEN {c} END)" for c in (total, count)]
            sums.append(safe_ratio(*pick).alias(f"{prefix}{name}"))
    both = per_order.agg(*sums)
    return both.withColumn("aov", safe_ratio("revenue", "order_count")).withColumn(
        "prev_aov", safe_ratio("prev_revenue", "prev_order_count")
    ), per_order


def kpi_report(model: SalesModel, year: int, month: int | None = None) -> DataFrame:
    """Dashboard KPIs for a year or month against the same period a year earlier.

    Growths are guarded (0.0 unless the base is positive, S11); average month-over-month
    growth only for a full year; trend indicators (F2) and currency labels (F1) included.
    """
    current, previous, cmp_year = _periods(year, month, None)
    # One per-(period, month, delivery, order) aggregation feeds the comparison (reviews
    # included) and the monthly revenue; the month-over-month branch uses conditional sums
    # rather than a filter, so no predicate is pushed below the shared aggregation and its
    # exchanges are reused: line items are scanned once.
    per_order_month = period_orders(model, current, previous)
    parts = [comparison_of(model, per_order_month)[0]]
    if month is None:
        monthly = (
            per_order_month.groupBy("month")
            .agg(
                money_total("CASE WHEN is_current THEN order_revenue END").alias("revenue"),
                F.expr("count(CASE WHEN is_current THEN 1 END)").alias("n_current"),
            )
            .where(F.col("n_current") > 0)
            .select("month", "revenue")
        )
        parts.append(avg_growth_of_months(monthly))
    merged = collapse_rows(parts)
    if month is None:
        mom = F.col("avg_monthly_growth")
    else:
        mom = F.lit(None).cast("double")
    out = merged.select(
        F.lit(year).alias("year"),
        F.lit(month).cast("int").alias("month"),
        F.lit(cmp_year).alias("comparison_year"),
        _label(year, month).alias("period_label"),
        "revenue",
        "prev_revenue",
        guarded_growth("revenue", "prev_revenue").alias("revenue_growth"),
        "aov",
        "prev_aov",
        guarded_growth("aov", "prev_aov").alias("aov_growth"),
        "order_count",
        "prev_order_count",
        guarded_growth("order_count", "prev_order_count").alias("order_growth"),
        mom.alias("avg_monthly_growth"),
        "avg_delivery_days",
        "prev_avg_delivery_days",
        guarded_growth("avg_delivery_days", "prev_avg_delivery_days").alias("delivery_growth"),
        "avg_score",
    )
    return out.select(
        "*",
        round_half_even("avg_score", 2).alias("avg_score_rounded"),
        currency_label("revenue").alias("revenue_label"),
        currency_label("aov").alias("aov_label"),
        *trend_columns("revenue_growth", prefix="revenue_"),
        *trend_columns("aov_growth", prefix="aov_"),
        *trend_columns("order_growth", prefix="order_"),
        *trend_columns("delivery_growth", inverted=True, prefix="delivery_"),
    )


def monthly_trend(model: SalesModel, year: int) -> DataFrame:
    """Revenue of months 1-12 for the year and the year before, zero-filled.

    Ignores any selected month, as the dashboard chart does.  The fixed 12-row month grid is
    left-joined to the per-month sums, which are broadcast: one row per month, at most 12.
    """
    cmp_year = year - 1
    sales = model.order_sales.where(period_predicate(year) | period_predicate(cmp_year))
    units = price_units(sales)
    by_month = sales.groupBy("month").agg(
        money_total(f"CASE WHEN year = {year} THEN {units} END").alias("cur"),
        money_total(f"CASE WHEN NOT (year = {year}) THEN {units} END").alias("prev"),
    )
    spark = model.orders.sparkSession
    grid = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return (
        grid.join(F.broadcast(by_month), "month", "left")
        .select(
            "month",
            month_name("month", short=True).alias("month_name"),
            F.coalesce("cur", F.lit(0.0)).alias("revenue"),
            F.coalesce("prev", F.lit(0.0)).alias("prev_revenue"),
        )
        .orderBy("month")
    )


def monthly_growth_report(model: SalesModel, year: int) -> DataFrame:
    """Month-over-month table of a full year with month names, then an average row."""
    sales = filter_by_period(model.order_sales, year)
    monthly = monthly_growth(sales)
    rows = monthly.select(
        F.col("month").cast("int").alias("month"),
        month_name("month").alias("month_name"),
        "growth",
    )
    avg_row = monthly.agg(F.expr(MEAN_GROWTH).alias("growth")).select(
        F.lit(None).cast("int").alias("month"), F.lit("Average").alias("month_name"), "growth"
    )
    # at most 13 rows: months in order, the average last
    return rows.unionByName(avg_row).orderBy(F.asc_nulls_last("month"))


def summary(model: SalesModel, year: int, month: int | None = None, comparison_year: int | None = None) -> DataFrame:
    """Executive summary of the notebook (P3): unguarded growths (zero base -> NULL), top
    category and state (A22: first row by revenue, key ascending on ties), averages."""
    current, previous, cmp_year = _periods(year, month, comparison_year)
    orders_by_period = period_orders(model, current, previous)
    comp, _ = comparison_of(model, orders_by_period)
    per_order = orders_by_period.groupBy("is_current", "order_id").agg(
        F.sum("order_revenue").alias("order_revenue")
    )
    cur_lines = model.sales.where(current)
    top_cat = top_n(
        revenue_by_category(cur_lines, model.products), 1, "revenue", "product_category_name"
    ).select(F.col("product_category_name").alias("top_category"))
    if model.keeps("customer_sales"):
        states = state_revenue(model, year, month)
    else:
        # Current-period revenue per order from the comparison's per-order rows: conditional
        # sums instead of a filter keep the shared aggregation (and its exchanges) identical.
        cur_per_order = (
            per_order.groupBy("order_id")
            .agg(
                F.expr("sum(CASE WHEN is_current THEN order_revenue END)").alias("key_revenue"),
                F.expr("count(CASE WHEN is_current THEN 1 END)").alias("n_current"),
            )
            .where(F.col("n_current") > 0)
            .select("order_id", "key_revenue")
        )
        states = state_revenue_from_orders(cur_per_order, model.orders, model.customers)
    top_state = top_n(states, 1, "price", "customer_state").select(F.col("customer_state").alias("top_state"))
    merged = collapse_rows([comp, top_cat, top_state])
    return merged.select(
        F.lit(year).alias("year"),
        F.lit(month).cast("int").alias("month"),
        F.lit(cmp_year).alias("comparison_year"),
        _label(year, month).alias("period_label"),
        "revenue",
        growth("revenue", "prev_revenue").alias("revenue_growth"),
        "aov",
        growth("aov", "prev_aov").alias("aov_growth"),
        "order_count",
        growth("order_count", "prev_order_count").alias("order_growth"),
        "top_category",
        "top_state",
        "avg_delivery_days",
        "avg_score",
    )


def period_cube(model: SalesModel) -> DataFrame:
    """Revenue, orders and AOV for every year and every (year, month) in one job (R-1), with
    the dashboard's guarded growth against the same period one year earlier.

    One per-order aggregation by (year, month, order) feeds both levels; it reuses the
    ``order_id`` partitioning of the order-grain fact.  The full-year order count regroups
    those rows by (year, order), so an order present in two months counts once.  The
    previous year's cell comes from a range window one year back over the cells -- at most
    years x 13 rows -- instead of a self-join.
    """
    base = model.order_sales.where(F.col("year").isNotNull())
    per_order = per_order_totals(base, "year", "month")
    by_month = per_order.groupBy("year", "month").agg(
        F.expr(wide_sum_sql("order_revenue")).alias("rev"), F.count(F.lit(1)).alias("order_count")
    )
    by_year = (
        per_order.groupBy("year", "order_id")
        .agg(F.sum("order_revenue").alias("order_revenue"))
        .groupBy("year")
        .agg(F.expr(wide_sum_sql("order_revenue")).alias("rev"), F.count(F.lit(1)).alias("order_count"))
        .withColumn("month", F.lit(None).cast("int"))
    )
    cells = by_month.unionByName(by_year).select(
        "year",
        "month",
        units_to_money("rev").alias("revenue"),
        "order_count",
        F.expr(safe_ratio_sql(units_to_money_sql("rev"), "order_count")).alias("aov"),
    )
    year_before = "OVER (PARTITION BY month ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    prev = {c: f"max({c}) {year_before}" for c in ("revenue", "order_count", "aov")}
    return cells.select(
        "year",
        "month",
        period_label("year", "month").alias("period_label"),
        "revenue",
        "order_count",
        "aov",
        guarded_growth("revenue", prev["revenue"]).alias("revenue_growth"),
        guarded_growth("aov", prev["aov"]).alias("aov_growth"),
        guarded_growth("order_count", prev["order_count"]).alias("order_growth"),
        currency_label("revenue").alias("revenue_label"),
        currency_label("aov").alias("aov_label"),
    ).orderBy("year", F.asc_nulls_first("month"))


def approx_period_cube(model: SalesModel) -> DataFrame:
    """``year, month, revenue, order_count, aov`` of every year and month from the month cells:
    revenue exact, order counts within ``SKETCH_ERROR`` (opt-in, R-1).  On stored facts it reads
    a few kilobytes a month instead of all orders."""
    by_month = order_count_of_cells(model.order_cells, "year", "month")
    by_year = order_count_of_cells(model.order_cells, "year").withColumn("month", F.lit(None).cast("int"))
    return by_month.unionByName(by_year).orderBy("year", F.asc_nulls_first("month"))


def top_categories(model: SalesModel, year: int, month: int | None = None, n: int = 10, with_rank: bool = False, chart_order: bool = False) -> DataFrame:
    """Top-n categories of a period (T1: dashboard top 10 with labels, T2: ranked top 15)."""
    cats = revenue_by_category(filter_by_period(model.sales, year, month), model.products)
    top = top_n(cats, n, "revenue", "product_category_name", ascending_output=chart_order, with_rank=with_rank)
    return top.withColumn("label", currency_label("revenue"))


def state_revenue(model: SalesModel, year: int, month: int | None = None) -> DataFrame:
    """Revenue by state of a period (A8).  A model with stored or cached facts reads the
    period's months at customer grain; otherwise each table is scanned once."""
    if model.keeps("customer_sales"):
        return state_revenue_from_customer_sales(filter_by_period(model.customer_sales, year, month), model.customers)
    return state_revenue_of_period(
        model.order_items, model.orders, model.customers, period_predicate(year, month), model.status, model.lenient
    )


def top_states(model: SalesModel, year: int, month: int | None = None, n: int = 10) -> DataFrame:
    """Top-n states of a period by revenue."""
    return top_n(state_revenue(model, year, month), n, "price", "customer_state")


def score_distribution_labeled(model: SalesModel, year: int, month: int | None = None) -> DataFrame:
    """Share per review score with its ``'n stars'`` label."""
    sales = delivery_metrics(filter_by_period(model.order_sales, year, month))
    dist = score_distribution(review_speed(sales, model.reviews))
    return dist.withColumn("label", score_label("review_score"))


def score_by_bucket_report(model: SalesModel, year: int, month: int | None = None) -> DataFrame:
    sales = delivery_metrics(filter_by_period(model.order_sales, year, month))
    return score_by_bucket(review_speed(sales, model.reviews))
