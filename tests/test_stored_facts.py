"""Stored facts: state revenue from them, refresh of touched months, bucketed tables, sketches,
score types."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL, ts
from orderlens.operators import product, revenue
from orderlens.operators.sales import filter_by_period
from orderlens.plans import reports
from orderlens.plans.model import FACTS, SalesModel
from orderlens.sources.bucketed import load_bucketed, save_bucketed, uneven
from orderlens.sources.tables import save_datasets
from test_plans import plan_text, tree

REPORTS = {
    "states": lambda m: reports.state_revenue(m, 2023),
    "states of a month": lambda m: reports.state_revenue(m, 2023, 2),
    "kpi": lambda m: reports.kpi_report(m, 2023),
    "summary": lambda m: reports.summary(m, 2023),
    "cube": reports.period_cube,
    "lines": lambda m: m.sales.groupBy("order_id", "year", "month").agg(F.sum(F.col("price").cast("decimal(18,2)")), F.count("*")).orderBy("order_id", "year", "month"),
}


def random_tables(rng, n=60):
    """Orders with repeated ids, other owners and periods per repeat, missing values."""
    days = ["2022-12-30", "2023-01-05", "2023-02-01", "2023-02-27", "2023-07-01", "2022-02-03", None]
    orders = []
    for _ in range(n):
        day = rng.choice(days)
        orders.append(
            (
                rng.choice([f"o{rng.randrange(n)}"] * 9 + [None]),
                rng.choice([f"c{rng.randrange(12)}"] * 9 + [None]),
                rng.choice(["delivered"] * 4 + ["shipped"]),
                day and day + " 10:00:00",
                rng.choice([None, "2023-09-09 00:00:00"]),
            )
        )
    items = [(rng.choice([f"o{rng.randrange(n)}"] * 9 + [None]), i, f"p{rng.randrange(5)}", rng.randrange(1, 5000) / 100) for i in range(3 * n)]
    products = [(f"p{i}", f"cat{i % 3}") for i in range(5)]
    customers = [(f"c{i}", rng.choice(["SP", "RJ", "MG", None])) for i in range(12)] + [("c1", "BA")]
    reviews = [(f"o{rng.randrange(n)}", rng.choice([1, 2, 3, 4, 5, None])) for _ in range(n)]
    return {"orders": orders, "items": items, "products": products, "customers": customers, "reviews": reviews}


def files(path):
    out = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                full = os.path.join(folder, name)
                out[os.path.relpath(full, path)] = os.stat(full).st_mtime_ns
    return out


def test_state_revenue_reads_the_months_partition_alone(spark, tmp_path):
    fixtures = SalesModel.from_fixtures(spark, SF_SMALL)
    save_datasets(fixtures.tables, str(tmp_path / "data"))
    fixtures.materialize(str(tmp_path / "facts"))
    model = SalesModel.from_materialized(spark, str(tmp_path / "facts"), str(tmp_path / "data"))
    got = reports.state_revenue(model, 2000, 3)
    assert got.collect() == reports.state_revenue(fixtures, 2000, 3).collect()
    text = plan_text(got)
    scans = re.findall(r"Location: \S+ \[[^\]]*/(\w+)(?:\.parquet)?[,\]]", text)
    assert sorted(set(scans)) == ["customer_sales", "customers"], text
    assert "PartitionFilters: [isnotnull(year" in text and "(month" in text
    # only the files of that month are listed
    month = filter_by_period(model.customer_sales, 2000, 3)
    assert {re.search(r"year=\d+/month=\d+", f).group() for f in month.inputFiles()} >= {"year=2000/month=3"}
    for report in (lambda m: reports.summary(m, 2000, 3), lambda m: reports.top_states(m, 2000, n=3)):
        assert report(model).collect() == report(fixtures).collect()


@pytest.mark.parametrize("seed", range(2))
def test_repeated_orders_stay_exact_on_stored_facts(toy, tmp_path, seed):
    model = toy(**random_tables(random.Random(seed)))
    stored = model.materialize(str(tmp_path / "facts"))
    assert all(stored.keeps(f) for f in FACTS) and not model.keeps("sales")
    for name, report in REPORTS.items():
        assert report(stored).collect() == report(model).collect(), name
    for year, month in ((2023, None), (2023, 2), (2022, 12), (2021, None)):
        want = product.revenue_by_state(filter_by_period(model.sales, year, month), model.orders, model.customers)
        assert reports.state_revenue(stored, year, month).collect() == want.collect()


def test_persisted_model_answers_state_revenue_from_its_cache(toy):
    model = toy(**random_tables(random.Random(7)))
    want = REPORTS["states"](model).collect()
    kept = toy(**random_tables(random.Random(7))).persist()
    got = REPORTS["states"](kept)
    assert got.collect() == want and "InMemoryTableScan" in tree(got) and kept.keeps("customer_sales")


def test_a_late_order_rewrites_its_month_alone(spark, toy, tmp_path):
    rows = random_tables(random.Random(11))
    folder = str(tmp_path / "facts")
    toy(**rows).materialize(folder)
    before = files(folder)
    late = ("late", "c3", "delivered", "2023-02-14 12:00:00", "2023-02-20 12:00:00")
    rows["orders"].append(late)
    rows["items"] += [("late", 1, "p1", 10.5), ("late", 2, "p2", 1.25)]
    now = toy(**rows)
    fresh = now.refresh(folder, spark.createDataFrame([("late",), (None,), ("late",)], "order_id string"))
    after = files(folder)
    changed = {re.search(r"year=\w+/month=\w+", f).group() for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"year=2023/month=2"}
    for name, report in REPORTS.items():
        assert report(fresh).collect() == report(now).collect(), name


@pytest.mark.parametrize("seed", range(2))
def test_refresh_equals_a_rebuild(spark, toy, tmp_path, seed):
    """Added, removed, moved and re-owned orders, changed items, a month that loses all sales."""
    rng = random.Random(100 + seed)
    rows = random_tables(rng)
    folder = str(tmp_path / "facts")
    toy(**rows).materialize(folder)
    other = random_tables(rng)
    ids = {f"o{rng.randrange(60)}" for _ in range(12)} | {o[0] for o in rows["orders"] if o[3] and o[3].startswith("2023-07")} - {None}
    gone = {o[0] for o in rows["orders"] if o[3] and o[3].startswith("2023-07")}
    for table in ("orders", "items"):
        keep = [r for r in rows[table] if r[0] not in ids]
        new = [r for r in other[table] if r[0] in ids - gone and not (table == "orders" and r[3] and r[3].startswith("2023-07"))]
        rows[table] = keep + new
    now = toy(**rows)
    fresh = now.refresh(folder, spark.createDataFrame([(i,) for i in sorted(ids)], "order_id string"))
    rebuilt = now.materialize(str(tmp_path / "again"))
    for name, report in REPORTS.items():
        assert report(fresh).collect() == report(now).collect() == report(rebuilt).collect(), name
    for fact in ("sales", "customer_sales", "order_sales"):
        a, b = getattr(fresh, fact), getattr(rebuilt, fact)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), fact
    assert not os.path.exists(os.path.join(folder, "sales", "year=2023", "month=7")) or "2023-07" in str(rows["orders"])


def test_refresh_with_nothing_changed_keeps_every_file(spark, toy, tmp_path):
    model = toy(**random_tables(random.Random(5)))
    folder = str(tmp_path / "facts")
    model.materialize(folder)
    before = files(folder)
    model.refresh(folder, spark.createDataFrame([("nobody",)], "order_id string"))
    model.refresh(folder, spark.createDataFrame([], "order_id string"))
    assert files(folder) == before


def exchanges(spark, df):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return len(re.findall(r"\bExchange\b", tree(df)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    fixtures = SalesModel.from_fixtures(spark, SF_SMALL)
    save_bucketed(fixtures.tables, str(tmp_path / "b"), 4)
    for _ in range(2):  # as in a later session: definitions are made anew from the folder
        model = SalesModel.from_bucketed(spark, str(tmp_path / "b"))
    assert exchanges(spark, model.sales) == exchanges(spark, model.order_sales) == 0
    assert exchanges(spark, revenue.per_order_totals(model.order_sales, "year")) == 0
    assert exchanges(spark, fixtures.sales) == 2
    # reviews join the per-order chain without an exchange, too
    assert len(re.findall(r"hashpartitioning\(order_id", tree(reports.kpi_report(model, 2000)))) == 0
    assert model.sales.exceptAll(fixtures.sales).isEmpty() and model.sales.count() == fixtures.sales.count()
    for report in (lambda m: reports.kpi_report(m, 2000), lambda m: reports.state_revenue(m, 2000), lambda m: reports.summary(m, 2000, 3)):
        assert report(model).collect() == report(fixtures).collect()


def test_a_table_with_a_hot_key_is_stored_plain(spark, tmp_path, monkeypatch):
    from orderlens.sources import bucketed

    monkeypatch.setattr(bucketed, "SMALL_BUCKET_ROWS", 100)
    fixtures = SalesModel.from_fixtures(spark, SF_SMALL)
    n = fixtures.order_items.count()
    hot = fixtures.order_items.limit(1).crossJoin(spark.range(n)).drop("id")
    tables = {**fixtures.tables, "order_items": fixtures.order_items.unionByName(hot)}
    assert uneven(tables["order_items"], "order_id", 16) and not uneven(tables["orders"], "order_id", 16)
    save_bucketed(tables, str(tmp_path / "b"), 16)
    loaded = load_bucketed(spark, str(tmp_path / "b"))
    assert exchanges(spark, SalesModel(loaded).sales) >= 1
    assert revenue.total_revenue(SalesModel(loaded).sales).collect() == revenue.total_revenue(SalesModel(tables).sales).collect()


def test_order_sketches_merge_within_their_bound(spark, tmp_path):
    model = SalesModel.from_fixtures(spark, SF_CHECK)
    stored = model.materialize(str(tmp_path / "facts"))
    exact = {(r.year, r.month): r for r in reports.period_cube(model).collect()}
    for source in (model, stored):
        near = {(r.year, r.month): r for r in reports.approx_period_cube(source).collect()}
        assert near.keys() == exact.keys()
        for key, row in near.items():
            assert row.revenue == exact[key].revenue
            assert abs(row.order_count - exact[key].order_count) <= 3 * revenue.SKETCH_ERROR * exact[key].order_count
    # an order in several months counts once in the year
    orders = [("o", "c", "delivered", ts(f"2023-{m:02d}-01 00:00:00"), None) for m in range(1, 13)]
    schema = "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz"
    items = spark.createDataFrame([("o", 1, "p", 2.0)], "order_id string, order_item_id int, product_id string, price double")
    again = SalesModel({**model.tables, "orders": spark.createDataFrame(orders, schema), "order_items": items})
    assert [r.order_count for r in reports.approx_period_cube(again).collect()] == [1] * 13
    assert "order_sales" not in plan_text(reports.approx_period_cube(stored)).replace("order_sales_", "")


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_reports_take_any_score_type(toy, kind):
    rows = random_tables(random.Random(21))
    model = toy(**rows)
    score = F.col("review_score").cast(kind)
    if kind in ("float", "double"):
        score = F.coalesce(score, F.lit(float("nan")).cast(kind))
    other = SalesModel({**model.tables, "reviews": model.reviews.withColumn("review_score", score)})
    for report in (
        lambda m: reports.kpi_report(m, 2023),
        lambda m: reports.kpi_report(m, 2023, 2),
        lambda m: reports.summary(m, 2023),
        lambda m: reports.score_by_bucket_report(m, 2023),
    ):
        assert report(other).collect() == report(model).collect()
    labels = [tuple(r) for r in reports.score_distribution_labeled(other, 2023).collect()]
    assert [r[:2] for r in labels] == [tuple(r)[:2] for r in reports.score_distribution_labeled(model, 2023).collect()]


def test_fractional_scores_average_exactly(toy):
    rows = random_tables(random.Random(22))
    model = toy(**rows)
    half = SalesModel({**model.tables, "reviews": model.reviews.withColumn("review_score", F.col("review_score") / 2)})
    for year in (2022, 2023):
        want = reports.kpi_report(model, year).collect()[0]["avg_score"]
        got = reports.kpi_report(half, year).collect()[0]["avg_score"]
        assert got is None and want is None or got == pytest.approx(want / 2)
