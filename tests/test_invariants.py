
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from orderlens.operators import experience, product, profile, revenue
from orderlens.operators.sales import build_order_sales, filter_by_period
from orderlens.plans import reports
from orderlens.plans.model import SalesModel

YEAR = 2000


@pytest.fixture(scope="module")
def model(spark):
    return SalesModel.from_fixtures(spark, SF_SMALL)


def scalar(df, col):
    return df.collect()[0][col]


def test_shares_sum_to_one(model):
    table = experience.review_speed(experience.delivery_metrics(filter_by_period(model.order_sales, YEAR)), model.reviews)
    assert scalar(experience.score_distribution(table).agg(F.sum("share").alias("s")), "s") == pytest.approx(1.0)
    assert scalar(profile.order_status_share(model.orders, YEAR).agg(F.sum("share").alias("s")), "s") == pytest.approx(1.0)


def test_category_and_state_totals(model):
    sales = filter_by_period(model.sales, YEAR)
    total = scalar(revenue.total_revenue(sales), "revenue")
    cats = scalar(product.revenue_by_category(sales, model.products).agg(F.sum("revenue").alias("s")), "s")
    missing = (
        sales.join(model.products.where(F.col("product_category_name").isNull()), "product_id")
        .agg(F.sum("price").alias("s"))
        .collect()[0]["s"]
        or 0.0
    )
    assert cats + missing == pytest.approx(total, rel=1e-12)
    states = scalar(product.revenue_by_state(sales, model.orders, model.customers).agg(F.sum("price").alias("s")), "s")
    assert states == pytest.approx(total, rel=1e-12)


def test_cube_months_add_up_to_years(model):
    cube = reports.period_cube(model)
    years = {r["year"]: (r["revenue"], r["order_count"]) for r in cube.where(F.col("month").isNull()).collect()}
    months = cube.where(F.col("month").isNotNull()).groupBy("year").agg(
        F.sum("revenue").alias("r"), F.sum("order_count").alias("n")
    )
    for r in months.collect():
        assert r["r"] == pytest.approx(years[r["year"]][0], rel=1e-12)
        assert r["n"] == years[r["year"]][1]  # every order lies in one month


def test_aov_times_orders_is_revenue(model):
    sales = filter_by_period(model.order_sales, YEAR)
    a = scalar(revenue.aov(sales), "aov")
    n = scalar(revenue.order_count(sales), "order_count")
    total = scalar(revenue.total_revenue(sales), "revenue")
    assert a * n == pytest.approx(total, rel=1e-12)


def test_line_and_order_grain_agree(model):
    line, orders = filter_by_period(model.sales, YEAR), filter_by_period(model.order_sales, YEAR)
    for fn in (revenue.total_revenue, revenue.aov, revenue.order_count, revenue.monthly_revenue, revenue.monthly_growth):
        assert fn(line).collect() == fn(orders).collect()
    a = product.revenue_by_state(line, model.orders, model.customers).collect()
    b = product.revenue_by_state(orders, model.orders, model.customers).collect()
    assert a == b
    carried = filter_by_period(build_order_sales(model.order_items, model.orders, carry_customer=True), YEAR)
    c = product.revenue_by_state(carried, model.orders, model.customers, assume_unique_orders=True).collect()
    assert c == a  # order ids are unique in the fixtures
    ra = experience.review_speed(experience.delivery_metrics(line), model.reviews)
    rb = experience.review_speed(experience.delivery_metrics(orders), model.reviews)
    assert sorted(ra.collect()) == sorted(rb.collect())


def test_same_answer_for_any_partitioning(spark, model):
    before = reports.kpi_report(model, YEAR).collect()
    cube_before = reports.period_cube(model).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert reports.kpi_report(model, YEAR).collect() == before
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        shuffled = SalesModel({k: v.repartition(7) for k, v in model.tables.items()})
        assert reports.kpi_report(shuffled, YEAR).collect() == before
        assert reports.period_cube(shuffled).collect() == cube_before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
