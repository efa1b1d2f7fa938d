"""CSV and parquet loading (O1, O2) and hot-key skew."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from orderlens.operators import experience, product, revenue
from orderlens.operators.sales import filter_by_period
from orderlens.plans import reports
from orderlens.plans.model import SalesModel
from orderlens.sources.schemas import CSV_FILES
from orderlens.sources.tables import load_datasets, save_datasets, scan_counts


def _write_csv(df, path):
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path + ".dir")
    part = [f for f in os.listdir(path + ".dir") if f.startswith("part-")][0]
    os.link(os.path.join(path + ".dir", part), path)


def test_csv_round_trip(spark, tmp_path):
    fixtures = SalesModel.from_fixtures(spark, SF_SMALL)
    data_dir = str(tmp_path)
    for name, df in fixtures.tables.items():
        out = df
        for c, t in df.dtypes:
            if t.startswith("timestamp"):
                out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
        _write_csv(out, os.path.join(data_dir, CSV_FILES[name]))
    loaded = load_datasets(spark, data_dir, fmt="csv")
    assert dict(loaded["orders"].dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert dict(loaded["orders"].dtypes)["order_id"] == "string"
    counts = {r["table_name"]: r["row_count"] for r in scan_counts(loaded).collect()}
    expected = {r["table_name"]: r["row_count"] for r in scan_counts(fixtures.tables).collect()}
    assert counts == expected
    csv_model = SalesModel(loaded)
    a = reports.kpi_report(csv_model, 2000).drop("year").collect()[0].asDict()
    b = reports.kpi_report(fixtures, 2000).drop("year").collect()[0].asDict()
    assert a == b


def _text_tables(tables):
    out = {}
    for name, df in tables.items():
        for c, t in df.dtypes:
            if t.startswith("timestamp"):
                df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
        out[name] = df
    return out


@pytest.mark.parametrize("strict", [True, False])
def test_csv_by_name_with_shuffled_and_extra_columns(spark, tmp_path, strict):
    fixtures = SalesModel.from_fixtures(spark, SF_SMALL)
    for name, df in _text_tables(fixtures.tables).items():
        wide = df.withColumn("extra", F.lit("u1")).withColumn("Other", F.lit(7))
        _write_csv(wide.select("extra", *reversed(df.columns), "Other"), str(tmp_path / CSV_FILES[name]))
    model = SalesModel.from_files(spark, str(tmp_path), strict=strict)
    for report in (
        lambda m: reports.kpi_report(m, 2000),
        lambda m: product.revenue_by_state(filter_by_period(m.sales, 2000), m.orders, m.customers),
        lambda m: experience.delivery_metrics(m.sales).groupBy("delivery_speed", "delivery_time").count().orderBy("delivery_speed", "delivery_time"),
        lambda m: scan_counts(m.tables).orderBy("table_name"),
    ):
        assert report(model).collect() == report(fixtures).collect()
    assert model.customers.select("customer_state").distinct().count() > 1


def test_csv_missing_column_words_quotes_and_line_breaks(spark, tmp_path):
    from orderlens.sources.tables import read_csv
    from pyspark.sql import types as T

    path = str(tmp_path / "r.csv")
    with open(path, "w") as f:
        f.write('note,price,order_id,n\n"a ""quoted"", note",1.5,o1,3\n"two\nlines",NaN,o2,NA\nplain,null,N/A,\n')
    schema = T.StructType().add("order_id", "string").add("price", "double").add("n", "integer").add("note", "string")
    rows = [tuple(r) for r in read_csv(spark, path, schema, multi_line=True).collect()]
    assert rows == [
        ("o1", 1.5, 3, 'a "quoted", note'), ("o2", None, None, "two\nlines"), (None, None, None, "plain"),
    ]
    with pytest.raises(ValueError, match="gone"):
        read_csv(spark, path, T.StructType().add("gone", "string"))
    bad = str(tmp_path / "b.csv")
    with open(bad, "w") as f:
        f.write("price\n1.5\nmuch\n")
    only = T.StructType().add("price", "double")
    assert [r.price for r in read_csv(spark, bad, only, strict=False).collect()] == [1.5, None]
    with pytest.raises(Exception):
        read_csv(spark, bad, only).collect()


def test_stored_facts_open_in_a_new_model(spark, tmp_path):
    fixtures = SalesModel.from_fixtures(spark, SF_SMALL)
    save_datasets(fixtures.tables, str(tmp_path / "data"))
    fixtures.materialize(str(tmp_path / "facts"))
    model = SalesModel.from_materialized(spark, str(tmp_path / "facts"), str(tmp_path / "data"))
    assert model.order_sales.columns == fixtures.order_sales.columns
    assert reports.kpi_report(model, 2000).collect() == reports.kpi_report(fixtures, 2000).collect()
    month = filter_by_period(model.order_sales, 2000, 3)
    assert len({f.rsplit("/", 2)[1] for f in month.inputFiles()}) >= 1
    plan = revenue.total_revenue(month)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PartitionFilters" in plan


def test_parquet_loading(spark, tmp_path):
    fixtures = SalesModel.from_fixtures(spark, SF_SMALL)
    save_datasets(fixtures.tables, str(tmp_path))
    loaded = load_datasets(spark, str(tmp_path), fmt="parquet")
    assert revenue.total_revenue(SalesModel(loaded).order_sales).collect() == revenue.total_revenue(
        fixtures.order_sales
    ).collect()


def test_hot_order_key(spark):
    """One order holds a third of all line items and one customer a third of the orders: the
    answers stay exact (partial aggregation collapses the hot keys before shuffles)."""
    n = 3000
    orders = spark.range(n).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") % 3 == 0, F.lit("c0")).otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        F.lit("2021-05-01 10:00:00").cast("timestamp_ntz").alias("order_purchase_timestamp"),
        F.lit("2021-05-03 10:00:00").cast("timestamp_ntz").alias("order_delivered_customer_date"),
    )
    items = spark.range(3 * n).select(
        F.when(F.col("id") < n, F.lit("0")).otherwise((F.col("id") % n).cast("string")).alias("order_id"),
        F.lit(1).alias("order_item_id"),
        (F.col("id") % 7).cast("string").alias("product_id"),
        F.lit(1.25).alias("price"),
    )
    products = spark.range(7).select(F.col("id").cast("string").alias("product_id"), F.lit("cat").alias("product_category_name"))
    customers = orders.select("customer_id").distinct().withColumn("customer_state", F.lit("S"))
    reviews = orders.select("order_id", F.lit(5).alias("review_score"))
    m = SalesModel(dict(orders=orders, order_items=items, products=products, customers=customers, reviews=reviews))
    assert revenue.total_revenue(m.order_sales).collect()[0]["revenue"] == 3 * n * 1.25
    assert revenue.order_count(m.sales).collect()[0]["order_count"] == n
    assert product.revenue_by_category(m.sales, m.products).collect()[0]["revenue"] == 3 * n * 1.25
    assert product.revenue_by_state(m.order_sales, m.orders, m.customers).collect()[0]["price"] == 3 * n * 1.25
    table = experience.review_speed(experience.delivery_metrics(m.order_sales), m.reviews)
    assert table.count() == n


def test_command_line_reports(spark, tmp_path):
    from orderlens.__main__ import main

    fixtures = SalesModel.from_fixtures(spark, SF_SMALL)
    data = tmp_path / "data"
    for name, df in fixtures.tables.items():
        df.write.parquet(str(data / f"{name}.parquet"))
    out = tmp_path / "out"
    main(["--data", str(data), "--format", "parquet", "--year", "2000", "--out", str(out)])
    written = sorted(os.listdir(out))
    assert "kpi" in written and "summary" in written and "monthly_growth" in written
    kpi = spark.read.parquet(str(out / "kpi")).collect()[0]
    assert kpi["revenue"] == reports.kpi_report(fixtures, 2000).collect()[0]["revenue"]
