
from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from orderlens.functions.columns import currency_label, round_half_even, trend_columns
from orderlens.operators import experience, product, profile, revenue
from orderlens.operators.sales import build_order_sales, build_sales_data, filter_by_period, parse_timestamps
from orderlens.plans import reports

D = "delivered"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def col_list(df, name):
    return [r[name] for r in df.collect()]


def test_s1_empty_and_missing_sums_are_zero(toy):
    m = toy(
        orders=[("o1", "c1", D, "2023-01-05 10:00:00", "2023-01-07 10:00:00")],
        items=[("o1", 1, "p1", None)],
    )
    assert one(revenue.total_revenue(filter_by_period(m.sales, 2022)))["revenue"] == 0.0
    assert one(revenue.total_revenue(m.sales))["revenue"] == 0.0
    assert col_list(revenue.monthly_revenue(m.sales), "revenue") == [0.0]


def test_s2_missing_group_key_is_dropped(toy):
    m = toy(
        orders=[("o1", "c1", D, "2023-01-05 10:00:00", None)],
        items=[("o1", 1, "p1", 10.0), ("o1", 2, "p2", 5.0)],
        products=[("p1", None), ("p2", "toys")],
    )
    out = product.revenue_by_category(m.sales, m.products).collect()
    assert [(r["product_category_name"], r["revenue"]) for r in out] == [("toys", 5.0)]


def test_s3_empty_mean_is_null(toy):
    m = toy(orders=[("o1", "c1", D, "2023-01-05 10:00:00", None)], items=[("o1", 1, "p1", 1.0)])
    table = experience.review_speed(experience.delivery_metrics(m.sales), m.reviews)
    row = one(experience.review_summary(table))
    assert row["avg_score"] is None and row["avg_delivery_speed"] is None
    assert one(revenue.aov(filter_by_period(m.sales, 1999)))["aov"] is None


def test_s4_aov_is_mean_of_order_sums(toy):
    m = toy(
        orders=[
            ("o1", "c1", D, "2023-01-05 10:00:00", None),
            ("o2", "c1", D, "2023-01-06 10:00:00", None),
        ],
        items=[("o1", 1, "p1", 10.0), ("o1", 2, "p1", 20.0), ("o2", 1, "p1", None)],
    )
    assert one(revenue.aov(m.sales))["aov"] == 15.0
    assert one(revenue.aov(m.order_sales))["aov"] == 15.0
    assert one(revenue.order_count(m.sales))["order_count"] == 2
    assert one(revenue.order_count(m.sales, approx_rsd=0.01))["order_count"] == 2


def test_s5_floor_days_not_calendar_days(toy):
    m = toy(
        orders=[
            ("o1", "c1", D, "2023-01-01 10:00:00", "2023-01-03 09:00:00"),  # 47 h -> 1
            ("o2", "c1", D, "2023-01-01 10:00:00", "2023-01-01 09:00:00"),  # -1 h -> -1
            ("o3", "c1", D, "2023-01-01 10:00:00", "2023-01-04 10:00:00"),  # 72 h -> 3
        ],
        items=[("o1", 1, "p", 1.0), ("o2", 1, "p", 1.0), ("o3", 1, "p", 1.0)],
    )
    out = experience.delivery_metrics(m.sales).orderBy("order_id").collect()
    assert [r["delivery_speed"] for r in out] == [1, -1, 3]
    assert [r["delivery_time"] for r in out] == ["1-3 days"] * 3


def test_s6_s7_buckets_and_missing_delivery(toy):
    m = toy(
        orders=[
            ("o1", "c1", D, "2023-01-01 00:00:00", "2023-01-01 00:00:00"),  # 0 days
            ("o2", "c1", D, "2023-01-01 00:00:00", "2023-01-05 00:00:00"),  # 4
            ("o3", "c1", D, "2023-01-01 00:00:00", "2023-01-08 23:00:00"),  # 7
            ("o4", "c1", D, "2023-01-01 00:00:00", "2023-01-09 00:00:00"),  # 8
            ("o5", "c1", D, "2023-01-01 00:00:00", None),  # missing
        ],
        items=[(f"o{i}", 1, "p", 1.0) for i in range(1, 6)],
        reviews=[("o1", 5), ("o2", 4), ("o3", 3), ("o4", 2), ("o5", 1)],
    )
    d = experience.delivery_metrics(m.sales).orderBy("order_id").collect()
    assert [r["delivery_time"] for r in d] == ["1-3 days", "4-7 days", "4-7 days", "8+ days", "8+ days"]
    metrics = experience.review_metrics(experience.delivery_metrics(m.sales), m.reviews)
    # missing delivery skipped by the day mean, counted in the 8+ bucket mean
    assert one(metrics["avg_delivery_speed"])["avg_delivery_speed"] == pytest.approx((0 + 4 + 7 + 8) / 4)
    buckets = {r["delivery_time"]: r["review_score"] for r in metrics["score_by_delivery_bucket"].collect()}
    assert buckets == {"1-3 days": 5.0, "4-7 days": 3.5, "8+ days": 1.5}
    assert col_list(metrics["score_by_delivery_bucket"], "delivery_time") == ["1-3 days", "4-7 days", "8+ days"]


def test_s8_s9_growth_over_present_months_and_zero_base(toy):
    m = toy(
        orders=[
            ("o1", "c1", D, "2023-01-05 00:00:00", None),
            ("o2", "c1", D, "2023-03-05 00:00:00", None),
            ("o3", "c1", D, "2023-04-05 00:00:00", None),
            ("o4", "c1", D, "2023-05-05 00:00:00", None),
        ],
        items=[("o1", 1, "p", 100.0), ("o2", 1, "p", 50.0), ("o3", 1, "p", 0.0), ("o4", 1, "p", 10.0)],
    )
    g = revenue.monthly_growth(m.sales).collect()
    assert [r["month"] for r in g] == [1, 3, 4, 5]  # gap at 2 is not filled
    assert g[0]["growth"] is None
    assert g[1]["growth"] == -0.5  # March against January
    assert g[2]["growth"] == -1.0
    assert g[3]["growth"] is None  # after a zero month: NULL instead of inf
    # one growth is undefined, so the mean over all months is, too; without the zero month it is known
    assert one(revenue.avg_monthly_growth(m.sales))["avg_monthly_growth"] is None
    before = m.sales.where("month < 5")
    assert one(revenue.avg_monthly_growth(before))["avg_monthly_growth"] == pytest.approx(-0.75)


def test_s10_s11_zero_base_growth(toy):
    m = toy(
        orders=[("o1", "c1", D, "2023-02-05 00:00:00", "2023-02-06 00:00:00")],
        items=[("o1", 1, "p", 10.0)],
        products=[("p", "toys")],
        customers=[("c1", "SP")],
        reviews=[("o1", 4)],
    )
    s = one(reports.summary(m, 2023))
    assert s["revenue_growth"] is None and s["order_growth"] is None and s["aov_growth"] is None
    k = one(reports.kpi_report(m, 2023))
    assert k["revenue_growth"] == 0.0 and k["order_growth"] == 0.0 and k["delivery_growth"] == 0.0
    assert k["revenue_trend_dir"] == "up" and k["delivery_trend_good"] is False
    assert k["avg_monthly_growth"] is None  # a single month has no growth
    km = one(reports.kpi_report(m, 2023, 2))
    assert km["avg_monthly_growth"] is None and km["period_label"] == "February 2023"


def test_s12_nunique_ignores_missing(toy):
    m = toy(products=[("p1", None), ("p2", "a"), ("p3", "a"), ("p4", "b")])
    row = one(profile.product_profile(m.products))
    assert row["n_products"] == 4 and row["n_categories"] == 2
    # unique() keeps the missing value
    assert col_list(profile.distinct_values(m.products, "product_category_name"), "product_category_name") == [None, "a", "b"]


def test_s13_share_divides_by_non_missing(toy):
    m = toy(
        orders=[
            ("o1", "c", D, "2023-01-01 00:00:00", None),
            ("o2", "c", "canceled", "2023-01-01 00:00:00", None),
            ("o3", "c", D, "2023-06-01 00:00:00", None),
            ("o4", "c", None, "2023-06-01 00:00:00", None),
            ("o5", "c", "canceled", "2022-06-01 00:00:00", None),
        ]
    )
    share = {r["order_status"]: r["share"] for r in profile.order_status_share(m.orders, 2023).collect()}
    assert share == {"delivered": pytest.approx(2 / 3), "canceled": pytest.approx(1 / 3)}


def test_s14_s22_review_rows_distinct_with_missing_equal(toy):
    m = toy(
        orders=[("o1", "c", D, "2023-01-01 00:00:00", None), ("o2", "c", D, "2023-01-01 00:00:00", "2023-01-02 00:00:00")],
        items=[("o1", 1, "p", 1.0), ("o1", 2, "p", 2.0), ("o2", 1, "p", 1.0)],
        reviews=[("o1", 5), ("o1", 5), ("o2", 3), ("o2", 4)],
    )
    table = experience.review_speed(experience.delivery_metrics(m.sales), m.reviews)
    rows = sorted((r["order_id"], r["review_score"]) for r in table.collect())
    assert rows == [("o1", 5), ("o2", 3), ("o2", 4)]


def test_s15_duplicate_order_rows_multiply_revenue(toy):
    m = toy(
        orders=[("o1", "c1", D, "2023-01-01 00:00:00", None), ("o1", "c2", D, "2023-01-01 00:00:00", None)],
        items=[("o1", 1, "p", 10.0)],
        customers=[("c1", "SP"), ("c2", "RJ")],
        products=[("p", "toys")],
    )
    for sales in (m.sales, m.order_sales):
        assert one(revenue.total_revenue(sales))["revenue"] == 20.0
        assert one(revenue.order_count(sales))["order_count"] == 1
        assert one(revenue.aov(sales))["aov"] == 20.0
    # state revenue re-joins orders: each sales row meets both orders rows
    states = {r["customer_state"]: r["price"] for r in product.revenue_by_state(m.order_sales, m.orders, m.customers).collect()}
    line_states = {r["customer_state"]: r["price"] for r in product.revenue_by_state(m.sales, m.orders, m.customers).collect()}
    assert states == line_states == {"SP": 20.0, "RJ": 20.0}
    # R4 shortcut: each orders row keeps only its own customer, so repeated ids differ
    carried = build_order_sales(m.order_items, m.orders, carry_customer=True)
    shortcut = {r["customer_state"]: r["price"] for r in product.revenue_by_state(carried, m.orders, m.customers, assume_unique_orders=True).collect()}
    assert shortcut == {"SP": 10.0, "RJ": 10.0}
    assert col_list(product.revenue_by_category(m.sales, m.products), "revenue") == [20.0]


def test_s16_missing_keys_do_not_match(toy):
    m = toy(
        orders=[(None, "c1", D, "2023-01-01 00:00:00", None), ("o1", "c1", D, "2023-01-01 00:00:00", None)],
        items=[(None, 1, "p", 10.0), ("o1", 1, "p", 1.0)],
    )
    assert one(revenue.total_revenue(m.sales))["revenue"] == 1.0


def test_s18_ties_break_on_key(toy):
    m = toy(
        orders=[("o1", "c1", D, "2023-01-01 00:00:00", None)],
        items=[("o1", 1, "p1", 5.0), ("o1", 2, "p2", 5.0), ("o1", 3, "p3", 1.0)],
        products=[("p1", "zeta"), ("p2", "alpha"), ("p3", "mid")],
    )
    top = reports.top_categories(m, 2023, n=2, with_rank=True).collect()
    assert [(r["rank"], r["product_category_name"]) for r in top] == [(1, "alpha"), (2, "zeta")]
    chart = reports.top_categories(m, 2023, n=3, chart_order=True).collect()
    assert [r["product_category_name"] for r in chart] == ["mid", "zeta", "alpha"]


def test_s19_timestamp_parsing(spark):
    df = spark.createDataFrame(
        [("2023-01-01 10:00:00", None)], "order_purchase_timestamp string, order_delivered_customer_date string"
    )
    out = one(parse_timestamps(df))
    assert out["order_purchase_timestamp"].hour == 10 and out["order_delivered_customer_date"] is None
    bad = spark.createDataFrame([("not a time", None)], df.schema)
    with pytest.raises(Exception):
        parse_timestamps(bad).collect()
    assert one(parse_timestamps(bad, lenient=True))["order_purchase_timestamp"] is None


def test_s20_missing_purchase_time_matches_no_period(toy):
    m = toy(
        orders=[("o1", "c1", D, None, None), ("o2", "c1", D, "2023-01-01 00:00:00", None)],
        items=[("o1", 1, "p", 10.0), ("o2", 1, "p", 1.0)],
    )
    assert one(revenue.total_revenue(filter_by_period(m.sales, 2023)))["revenue"] == 1.0
    assert col_list(profile.available_years(m.sales), "year") == [2023]


def test_s21_review_metrics_only_reviewed_orders(toy):
    m = toy(
        orders=[
            ("o1", "c", D, "2023-01-01 00:00:00", "2023-01-03 00:00:00"),
            ("o2", "c", D, "2023-01-01 00:00:00", "2023-01-21 00:00:00"),
        ],
        items=[("o1", 1, "p", 1.0), ("o2", 1, "p", 1.0)],
        reviews=[("o1", 4)],
    )
    table = experience.review_speed(experience.delivery_metrics(m.sales), m.reviews)
    assert one(experience.review_summary(table))["avg_delivery_speed"] == 2.0


def _py_currency(val: float) -> str:
    # Specification of the label, written from the documented behaviour (F1).
    if val >= 1_000_000:
        return f"${val / 1_000_000:.1f}M"
    if val >= 1_000:
        return f"${val / 1_000:.0f}K"
    return f"${val:.0f}"


def test_s23_labels_round_like_python(spark):
    import random

    rng = random.Random(7)
    values = [999_999.0, 1_000_000.0, 2_150_000.0, 2_250_000.0, 999.5, 1_500.0, 2_500.0, 0.5, 1.5, 2.5, -5_000_000.0, 85.0, 300_000.0]
    values += [round(rng.uniform(0, 5e7), 2) for _ in range(300)]
    values += [rng.randint(0, 400) * 1250.0 for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = df.select("v", currency_label("v").alias("label"), round_half_even("v", 2).alias("r2")).collect()
    for r in out:
        assert r["label"] == _py_currency(r["v"]), r["v"]
        assert r["r2"] == round(r["v"], 2)
    g = spark.createDataFrame([(0.123456,), (-0.00004,), (0.0,)], "g double")
    trend = g.select(*trend_columns("g", prefix="x_")).collect()
    assert [(t["x_trend_dir"], t["x_trend_pct"]) for t in trend] == [("up", "12.35"), ("down", "0.00"), ("up", "0.00")]
    assert [f"{abs(x * 100):.2f}" for x in (0.123456, -0.00004, 0.0)] == ["12.35", "0.00", "0.00"]


def test_grains_agree_on_toy(toy):
    m = toy(
        orders=[
            ("o1", "c1", D, "2023-01-01 00:00:00", "2023-01-02 00:00:00"),
            ("o2", "c2", D, "2023-02-01 00:00:00", None),
            ("o3", "c1", "canceled", "2023-02-01 00:00:00", None),
        ],
        items=[("o1", 1, "p", 1.25), ("o1", 2, "q", 2.5), ("o2", 1, "p", 4.0), ("o3", 1, "p", 100.0)],
    )
    for fn in (revenue.total_revenue, revenue.aov, revenue.order_count, revenue.monthly_revenue, revenue.avg_monthly_growth):
        assert fn(m.sales).collect() == fn(m.order_sales).collect()
    assert build_sales_data(m.order_items, m.orders, status=None).count() == 4
    assert build_order_sales(m.order_items, m.orders, status=None).count() == 3
    assert not math.isnan(one(revenue.total_revenue(m.sales))["revenue"])


def test_money_finer_missing_and_wide(spark, toy):
    """Decimals up to the internal scale are exact, finer ones raise, NaN is missing, totals may
    exceed a long."""
    from pyspark.errors import PySparkException

    def total(prices):
        n = len(prices)
        m = toy(
            orders=[(f"o{i}", "c", D, "2023-01-05 00:00:00", None) for i in range(n)],
            items=[(f"o{i}", 1, "p", p) for i, p in enumerate(prices)],
        )
        line = one(revenue.total_revenue(m.sales))["revenue"]
        assert line == one(revenue.total_revenue(m.order_sales))["revenue"]
        return line

    assert total([0.004] * 3) == 0.012
    assert total([1.25, 2.125, 0.0625]) == 3.4375
    assert total([float("nan"), 5.0, None]) == 5.0
    assert total([-0.0001, 0.0003]) == 0.0002
    assert total([9.0e13] * 20) == 1.8e15  # 1.8e19 units
    with pytest.raises(PySparkException, match="more than 4 decimals"):
        total([0.00001])


def test_month_table_is_ordered(spark, toy):
    m = toy(
        orders=[(f"o{i}", "c", D, f"2023-{i:02d}-05 00:00:00", None) for i in range(1, 13)],
        items=[(f"o{i}", 1, "p", 10.0 * i) for i in range(1, 13)],
    )
    rows = reports.monthly_growth_report(m, 2023).collect()
    assert [r["month"] for r in rows] == [*range(1, 13), None] and rows[-1]["month_name"] == "Average"


def test_lenient_model_reads_bad_timestamps_as_missing(spark, toy):
    from pyspark.sql import functions as F

    m = toy(
        orders=[("o1", "c", D, "2023-01-05 00:00:00", None), ("o2", "c", D, "2023-02-05 00:00:00", None)],
        items=[("o1", 1, "p", 10.0), ("o2", 1, "p", 20.0)],
    )
    text = F.when(F.col("order_id") == "o2", F.lit("soon")).otherwise(
        F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")
    )
    tables = dict(m.tables, orders=m.orders.withColumn("order_purchase_timestamp", text))
    loose = type(m)(tables, lenient=True)
    assert one(revenue.total_revenue(filter_by_period(loose.order_sales, 2023)))["revenue"] == 10.0
    with pytest.raises(Exception):
        revenue.total_revenue(filter_by_period(type(m)(tables).order_sales, 2023)).collect()
