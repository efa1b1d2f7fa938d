"""

Each entry takes ``(spark, sf_dir)``, builds the fixture tables from the driver parquet files
and returns a lazy DataFrame.  The analysis period follows FIXTURES.md: year 2000 against
1999 (both full), March for the month form, 2001 (ends in August) for the partial year.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import growth
from ..operators import experience, product, profile, revenue
from ..operators.quantile import describe
from ..operators.sales import filter_by_period, period_predicate
from ..session import new_folder, session_key
from ..sources.bucketed import save_bucketed
from ..sources.tables import scan_counts
from . import reports
from .model import SalesModel

YEAR = 2000
MONTH = 3
PARTIAL_YEAR = 2001

QueryFn = Callable[[SparkSession, str], DataFrame]


# One lazy model per (application, data directory): the fixture views and the two facts are
# plans, not data, so every query still executes from the parquet files.
_MODELS: dict[tuple[str, str], SalesModel] = {}


def _model(spark: SparkSession, sf_dir: str) -> SalesModel:
    key = (session_key(spark), sf_dir)
    if key not in _MODELS:
        _MODELS[key] = SalesModel.from_fixtures(spark, sf_dir)
    return _MODELS[key]


def _year_sales(m: SalesModel) -> DataFrame:
    return filter_by_period(m.sales, YEAR)


def _year_orders(m: SalesModel) -> DataFrame:
    return filter_by_period(m.order_sales, YEAR)


def _review_table(m: SalesModel, year: int = YEAR, month: int | None = None) -> DataFrame:
    sales = experience.delivery_metrics(filter_by_period(m.order_sales, year, month))
    return experience.review_speed(sales, m.reviews)


def _growth_query(metric: str) -> Callable[[SalesModel], DataFrame]:
    def run(m: SalesModel) -> DataFrame:
        comp = revenue.period_comparison(m.order_sales, period_predicate(YEAR), period_predicate(YEAR - 1))
        return comp.select(
            F.col(metric),
            F.col(f"prev_{metric}"),
            growth(metric, f"prev_{metric}").alias(f"{metric}_growth"),
        )

    return run


def _stored(m: SalesModel) -> SalesModel:
    """The model with its facts written to a new folder and opened from there."""
    return m.materialize(new_folder(m.orders.sparkSession, "facts"))


def _refreshed(m: SalesModel) -> SalesModel:
    """Facts stored before the orders of (YEAR, MONTH) had arrived, then refreshed with them."""
    ts = F.to_date("order_purchase_timestamp")
    arrives = (F.year(ts) == YEAR) & (F.month(ts) == MONTH)
    early = m.orders.where(~F.coalesce(arrives, F.lit(False)))
    folder = new_folder(m.orders.sparkSession, "facts")
    SalesModel({**m.tables, "orders": early}, m.status, m.lenient).materialize(folder)
    return m.refresh(folder, m.orders.where(arrives))


BUCKETS = 16


def _bucketed(m: SalesModel) -> SalesModel:
    spark = m.orders.sparkSession
    folder = new_folder(spark, "bucketed")
    save_bucketed(m.tables, folder, BUCKETS)
    return SalesModel.from_bucketed(spark, folder)


def _double_scores(m: SalesModel) -> SalesModel:
    """Review scores as a pandas export has them: doubles, a missing one as NaN."""
    score = F.coalesce(F.col("review_score").cast("double"), F.lit(float("nan")))
    return SalesModel({**m.tables, "reviews": m.reviews.withColumn("review_score", score)}, m.status, m.lenient)


def _order_count_sketches(m: SalesModel) -> DataFrame:
    """Exact orders of every year and month, and whether the merged sketches come within three
    standard errors of them."""
    exact = reports.period_cube(m).select("year", "month", "order_count")
    near = reports.approx_period_cube(_stored(m)).select(
        F.col("year").alias("y"), F.col("month").alias("m"), F.col("order_count").alias("estimate")
    )
    both = exact.join(near, F.col("year").eqNullSafe(F.col("y")) & F.col("month").eqNullSafe(F.col("m")))
    bound = F.col("order_count") * (3 * revenue.SKETCH_ERROR)
    return both.select("year", "month", "order_count", (F.abs(F.col("estimate") - F.col("order_count")) <= bound).alias("within_bound"))


def _on_model(fn: Callable[[SalesModel], DataFrame]) -> QueryFn:
    return lambda spark, sf_dir: fn(_model(spark, sf_dir))


_MODEL_QUERIES: dict[str, Callable[[SalesModel], DataFrame]] = {
    # sources and the sales fact
    "scan_counts": lambda m: scan_counts(m.tables),
    "sales_base": lambda m: m.sales,
    "sales_period_year": lambda m: filter_by_period(m.sales, YEAR),
    "sales_period_month": lambda m: filter_by_period(m.sales, YEAR, MONTH),
    "delivery_metrics": lambda m: experience.delivery_metrics(m.sales),
    "preview_sales": lambda m: profile.preview(m.sales, 5),
    # revenue and orders
    "total_revenue": lambda m: revenue.total_revenue(_year_orders(m)),
    "monthly_revenue": lambda m: revenue.monthly_revenue(_year_orders(m)),
    "revenue_year_month": lambda m: revenue.revenue_year_month(m.order_sales),
    "monthly_growth": lambda m: revenue.monthly_growth(_year_orders(m)),
    "avg_monthly_growth": lambda m: revenue.avg_monthly_growth(_year_orders(m)),
    "aov": lambda m: revenue.aov(_year_orders(m)),
    "order_count": lambda m: revenue.order_count(_year_orders(m)),
    "revenue_growth": _growth_query("revenue"),
    "aov_growth": _growth_query("aov"),
    "order_count_growth": _growth_query("order_count"),
    "period_counts": lambda m: profile.period_counts(m.order_sales, period_predicate(YEAR), period_predicate(YEAR - 1)),
    # product and geography
    "revenue_by_category": lambda m: product.revenue_by_category(_year_sales(m), m.products),
    "revenue_by_category_month": lambda m: product.revenue_by_category(
        filter_by_period(m.sales, YEAR, MONTH), m.products
    ),
    "categories_with_sales": lambda m: product.category_count(product.revenue_by_category(_year_sales(m), m.products)),
    "top_categories_10": lambda m: reports.top_categories(m, YEAR, n=10, chart_order=True),
    "top_categories_15": lambda m: reports.top_categories(m, YEAR, n=15, with_rank=True),
    "revenue_by_state": lambda m: reports.state_revenue(m, YEAR),
    "revenue_by_state_month": lambda m: reports.state_revenue(m, YEAR, MONTH),
    "top_states_10": lambda m: reports.top_states(m, YEAR, n=10),
    "state_revenue_scale": lambda m: product.state_revenue_scale(
        reports.state_revenue(m, YEAR)
    ),
    "revenue_labels": lambda m: product.state_scale_labels(
        reports.state_revenue(m, YEAR)
    ),
    # customer experience
    "review_speed": lambda m: _review_table(m),
    "review_summary": lambda m: experience.review_summary(_review_table(m)),
    "review_summary_month": lambda m: experience.review_summary(_review_table(m, YEAR, MONTH)),
    "score_distribution": lambda m: reports.score_distribution_labeled(m, YEAR),
    "score_by_bucket": lambda m: reports.score_by_bucket_report(m, YEAR),
    "score_by_delivery_day": lambda m: experience.score_by_delivery_day(_review_table(m)),
    "order_status_share": lambda m: profile.order_status_share(m.orders, YEAR),
    # profiling
    "product_profile": lambda m: profile.product_profile(m.products),
    "distinct_categories": lambda m: profile.distinct_values(m.products, "product_category_name"),
    "distinct_statuses": lambda m: profile.distinct_values(m.orders, "order_status"),
    "available_years": lambda m: profile.available_years(m.order_sales),
    "sales_date_range": lambda m: profile.sales_date_range(m.order_sales),
    "describe_items": lambda m: describe(m.order_items),
    # reports
    "kpi_report": lambda m: reports.kpi_report(m, YEAR),
    "kpi_report_month": lambda m: reports.kpi_report(m, YEAR, MONTH),
    "kpi_report_partial_year": lambda m: reports.kpi_report(m, PARTIAL_YEAR),
    "monthly_trend": lambda m: reports.monthly_trend(m, PARTIAL_YEAR),
    "monthly_growth_report": lambda m: reports.monthly_growth_report(m, YEAR),
    "summary": lambda m: reports.summary(m, YEAR),
    "summary_month": lambda m: reports.summary(m, YEAR, MONTH),
    "period_cube": lambda m: reports.period_cube(m),
    # stored facts, refreshed facts, bucketed tables, other score types
    "revenue_by_state_stored": lambda m: reports.state_revenue(_stored(m), YEAR),
    "revenue_by_state_month_stored": lambda m: reports.state_revenue(_stored(m), YEAR, MONTH),
    "summary_month_refreshed": lambda m: reports.summary(_refreshed(m), YEAR, MONTH),
    "period_cube_refreshed": lambda m: reports.period_cube(_refreshed(m)),
    "order_count_sketches": _order_count_sketches,
    "kpi_report_bucketed": lambda m: reports.kpi_report(_bucketed(m), YEAR),
    "kpi_report_double_scores": lambda m: reports.kpi_report(_double_scores(m), YEAR),
    "summary_double_scores": lambda m: reports.summary(_double_scores(m), YEAR),
}


def queries() -> dict[str, QueryFn]:
    return {name: _on_model(fn) for name, fn in _MODEL_QUERIES.items()}
