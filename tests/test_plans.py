"""Physical-plan checks: built-in expressions only, top-k plans, pushdown, reused partitioning."""

from __future__ import annotations

import contextlib
import io
import re

import pytest


from conftest import SF_SMALL
from orderlens.operators import product, revenue
from orderlens.operators.sales import filter_by_period
from orderlens.plans import catalog, reports
from orderlens.plans.model import SalesModel

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def tree(df) -> str:
    return plan_text(df).split("\n\n(")[0]


@pytest.fixture(scope="module")
def model(spark):
    return SalesModel.from_fixtures(spark, SF_SMALL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_in_any_query(spark, name):
    text = plan_text(catalog.queries()[name](spark, SF_SMALL))
    assert not any(node in text for node in PYTHON_NODES), name


def test_top_k_plans_as_take_ordered(spark, model):
    for df in (
        reports.top_categories(model, 2000, n=10),
        reports.top_states(model, 2000, n=10),
    ):
        assert "TakeOrderedAndProject" in tree(df)


def test_order_grain_aggregation_reuses_join_partitioning(spark, model):
    """Per-order aggregation after the sort-merge join needs no exchange of its own."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tree(revenue.per_order_totals(model.order_sales, "year", "month"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan
    # one exchange per join side, none above the join
    assert len(re.findall(r"\bExchange\b", plan)) == 2


def test_pre_aggregation_before_dimension_joins(spark, model):
    """Line items are reduced per product / per customer before the dimension join."""
    plan = tree(product.revenue_by_category(filter_by_period(model.sales, 2000), model.products))
    join_pos = plan.index("Join")
    # a HashAggregate sits below (after, in the printed tree) the category join
    assert "HashAggregate" in plan[join_pos:]


def test_period_range_pushed_to_parquet(spark, model, tmp_path):
    """On stored tables the period becomes a timestamp range in PushedFilters."""
    path = str(tmp_path / "orders")
    model.orders.write.parquet(path)
    stored = dict(model.tables, orders=spark.read.parquet(path))
    m = SalesModel(stored)
    text = plan_text(revenue.total_revenue(filter_by_period(m.order_sales, 2000)))
    pushed = [line for line in text.splitlines() if "PushedFilters" in line and "order_purchase_timestamp" in line]
    assert pushed, text
    assert "GreaterThanOrEqual(order_purchase_timestamp" in pushed[0]
    assert "LessThan(order_purchase_timestamp" in pushed[0]
    assert "EqualTo(order_status,delivered)" in pushed[0]


def test_column_pruning_reaches_scan(spark, model):
    text = plan_text(revenue.total_revenue(model.order_sales))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    lineitem = [s for s in schemas if "l_orderkey" in s]
    assert lineitem and all("l_comment" not in s and "l_quantity" not in s for s in lineitem)


def test_materialized_facts_prune_partitions(spark, model, tmp_path):
    stored = model.materialize(str(tmp_path / "facts"))
    df = filter_by_period(stored.order_sales, 2000, 3)
    text = plan_text(revenue.total_revenue(df))
    assert "PartitionFilters" in text and "isnotnull(year" in text
    assert revenue.total_revenue(df).collect() == revenue.total_revenue(filter_by_period(model.order_sales, 2000, 3)).collect()


def test_runtime_bloom_filter_lands_below_pre_aggregation(spark, model):
    """With a shuffle join, the filtered orders build a bloom filter that prunes line items
    at the scan, before the per-order partial aggregation and its shuffle."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b",
    }
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        text = plan_text(revenue.total_revenue(filter_by_period(model.order_sales, 2000)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    blocks = text.split("\n\n")
    bloom = [b for b in blocks if b.startswith("(") and " Filter" in b.splitlines()[0] and "might_contain" in b]
    assert bloom, text
    node_id = int(bloom[0].split(")")[0].strip("("))
    # the node right below the filter is the line-item scan
    scan = re.search(rf"\({node_id - 1}\) Scan parquet.*?ReadSchema: ([^\n]*)", text, re.S)
    assert scan and "l_orderkey" in scan.group(1)
    # and the partial aggregation is above it
    above = [b for b in blocks if b.startswith(f"({node_id + 2}) HashAggregate")]
    assert above and "partial_sum" in above[0]


def _scans(spark, df, column: str) -> int:
    """Scans of parquet files that read ``column`` in the final plan, reused exchanges aside."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    return len(re.findall(rf"FileScan parquet \[[^\]]*{column}", plan.split("== Initial Plan ==")[0]))


def test_line_item_and_order_scans_of_reports(spark, model):
    """Prices are scanned once by the KPI report and twice by the summary (the second time at
    line grain for the category); state revenue scans every table once."""
    assert _scans(spark, reports.kpi_report(model, 2000), "l_extendedprice") == 1
    assert _scans(spark, reports.summary(model, 2000), "l_extendedprice") == 2
    for column in ("o_orderkey", "l_orderkey", "c_custkey"):
        assert _scans(spark, reports.state_revenue(model, 2000), column) == 1


def test_state_revenue_of_period_equals_the_join_back(spark, toy):
    """Repeated order ids with other customers, periods and states fan out alike."""
    m = toy(
        orders=[
            ("o1", "c1", "delivered", "2023-01-05 00:00:00", None), ("o1", "c2", "delivered", "2022-01-05 00:00:00", None),
            ("o1", "c2", "shipped", "2023-01-06 00:00:00", None), ("o2", "c1", "delivered", "2023-02-05 00:00:00", None),
            ("o2", None, "delivered", "2023-02-05 00:00:00", None), ("o3", "c3", "shipped", "2023-02-05 00:00:00", None),
            (None, "c1", "delivered", "2023-02-05 00:00:00", None),
        ],
        items=[("o1", 1, "p", 10.0), ("o1", 2, "p", 5.5), ("o2", 1, "p", 3.25), ("o3", 1, "p", 7.0), (None, 1, "p", 1.0)],
        customers=[("c1", "SP"), ("c2", "RJ"), ("c2", "MG"), ("c3", "SP"), ("c4", None)],
    )
    for year, month in ((2023, None), (2023, 1), (2022, None), (2021, None)):
        want = product.revenue_by_state(filter_by_period(m.sales, year, month), m.orders, m.customers).collect()
        assert reports.state_revenue(m, year, month).collect() == want


def test_describe_is_lazy_and_shuffles_little(spark, model):
    """Building ``describe`` runs no job; no distinct value outside the brackets is shuffled."""
    from orderlens.operators.quantile import describe

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("describe-build", "no job expected")
    df = describe(model.order_items)
    assert list(tracker.getJobIdsForGroup("describe-build")) == []
    spark.sparkContext.setJobGroup("other", "")
    assert "RangePartitioning" not in plan_text(df) and "rangepartitioning" not in plan_text(df)
