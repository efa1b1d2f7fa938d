"""Opt-in joins in which missing keys match missing keys, against pandas' merge."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import product
from orderlens.operators.joins import join_pairing_missing
from orderlens.operators.sales import build_sales_data

D = "delivered"
TIME = "2023-01-01 00:00:00"


def random_tables(seed, hot=0):
    rnd = random.Random(seed)
    pick = lambda name, n: rnd.choice([None, *[f"{name}{k}" for k in range(n)]])
    orders = [(pick("o", 12), pick("c", 6), rnd.choice([D, D, "canceled"]), TIME, None) for _ in range(15)]
    orders += [(None, "c1", D, TIME, None), (None, None, D, TIME, None)]
    items = [(pick("o", 12), k, pick("p", 8), rnd.randrange(1, 5000) / 100) for k in range(40)]
    items += [(None, k, None, 1.25) for k in range(hot)]
    products = [(pick("p", 8), pick("cat", 4)) for _ in range(10)]
    customers = [(pick("c", 6), pick("S", 3)) for _ in range(8)]
    return {"orders": orders, "items": items, "products": products, "customers": customers}


def merged(rows):
    frame = lambda name, *cols: pd.DataFrame([r[: len(cols)] for r in rows[name]], columns=cols, dtype=object)
    orders = frame("orders", "order_id", "customer_id", "order_status")
    items = frame("items", "order_id", "order_item_id", "product_id", "price")
    sales = items.merge(orders[orders.order_status == D][["order_id"]], on="order_id")
    by_category = sales.merge(frame("products", "product_id", "category"), on="product_id").groupby("category").price.sum()
    by_state = (
        sales.merge(orders[["order_id", "customer_id"]], on="order_id")
        .merge(frame("customers", "customer_id", "state"), on="customer_id").groupby("state").price.sum()
    )
    return sales, by_category.to_dict(), by_state.to_dict()


@pytest.mark.parametrize("seed, hot", [(1, 0), (2, 0), (3, 0), (4, 300)])
def test_equals_pandas_merge(toy, seed, hot):
    rows = random_tables(seed, hot)
    m = toy(**rows)
    want, by_category, by_state = merged(rows)
    sales = build_sales_data(m.order_items, m.orders, pair_missing=True)
    got = [(r.order_id or "", r.order_item_id, r.price) for r in sales.collect()]
    assert sorted(got) == sorted((o or "", k, p) for o, k, p in zip(want.order_id, want.order_item_id, want.price))
    assert sum(g[0] == "" for g in got) > 0
    categories = product.revenue_by_category(sales, m.products, pair_missing=True).collect()
    assert {r[0]: r[1] for r in categories} == pytest.approx(by_category)
    states = product.revenue_by_state(sales, m.orders, m.customers, pair_missing=True).collect()
    assert {r[0]: r[1] for r in states} == pytest.approx(by_state)


def test_missing_keys_are_spread_over_tasks(spark):
    left = spark.range(20_000).selectExpr("if(id % 3 = 0, NULL, id) AS k", "id AS a")
    right = spark.createDataFrame([(None, 1), (None, 2), (7, 3)], "k long, b int")
    plan = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in plan}
    try:
        for c, v in plan.items():
            spark.conf.set(c, v)
        joined = join_pairing_missing(left, right, "k")
        assert joined.columns == ["k", "a", "b"]
        tasks = joined.where("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert joined.where("k = 7").count() == 1
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    counts = [r["count"] for r in tasks]
    assert sum(counts) == 2 * 6667 and len(counts) >= 6 and max(counts) < 0.4 * sum(counts)


def test_no_missing_keys_and_empty_tables(toy):
    rows = {"orders": [("o", "c", D, TIME, None)], "items": [("o", 1, "p", 2.0)], "products": [("p", "x")], "customers": [("c", "S")]}
    m = toy(**rows)
    sales = build_sales_data(m.order_items, m.orders, pair_missing=True)
    assert sales.collect() == m.sales.collect()
    assert product.revenue_by_category(sales, m.products, pair_missing=True).collect() == product.revenue_by_category(m.sales, m.products).collect()
    none = toy()
    sales = build_sales_data(none.order_items, none.orders, pair_missing=True)
    assert product.revenue_by_state(sales, none.orders, none.customers, pair_missing=True).collect() == []
    with pytest.raises(ValueError):
        product.revenue_by_state(sales, none.orders, none.customers, assume_unique_orders=True, pair_missing=True)
