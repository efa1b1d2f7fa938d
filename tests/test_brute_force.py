"""Random small tables against a brute-force computation of the same semantics.

The tables include duplicate order rows, items of unknown or missing orders, missing prices,
categories, states, purchase and delivery times, duplicate dimension rows and hot keys.  The
"""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from orderlens.operators import experience, product, revenue
from orderlens.operators.sales import filter_by_period
from orderlens.plans import reports
from orderlens.plans.model import SalesModel
from orderlens.sources.schemas import table_schemas

YEAR = 2022
STATUSES = ["delivered", "delivered", "delivered", "canceled", "shipped", None]


def make_tables(seed: int):
    rng = random.Random(seed)
    n_orders = rng.randint(5, 40)
    order_ids = [f"o{i}" for i in range(n_orders)]
    orders = []
    for oid in order_ids:
        copies = 2 if rng.random() < 0.1 else 1
        for _ in range(copies):
            purchase = None
            if rng.random() > 0.05:
                purchase = dt.datetime(rng.choice([YEAR - 1, YEAR]), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23))
            delivered = None
            if purchase is not None and rng.random() > 0.15:
                delivered = purchase + dt.timedelta(hours=rng.randint(-5, 400))
            orders.append((oid, f"c{rng.randint(0, 6)}", rng.choice(STATUSES), purchase, delivered))
    hot = rng.choice(order_ids)
    items = []
    for k in range(rng.randint(10, 120)):
        oid = hot if rng.random() < 0.33 else rng.choice(order_ids + ["missing", None])
        price = None if rng.random() < 0.05 else round(rng.uniform(0, 500), 2)
        items.append((oid, k % 4 + 1, f"p{rng.randint(0, 9)}", price))
    products = [(f"p{i}", rng.choice(["toys", "books", "garden", None])) for i in range(10)]
    products.append(("p1", "books"))  # a duplicate product row fans out
    customers = [(f"c{i}", rng.choice(["SP", "RJ", "MG", None])) for i in range(7)]
    reviews = [(rng.choice(order_ids), rng.randint(1, 5)) for _ in range(rng.randint(0, 60))]
    return dict(orders=orders, order_items=items, products=products, customers=customers, reviews=reviews)


def cents(p):
    return int(round(Decimal(str(p)) * 100))


def money(c):
    return float(Decimal(c) / 100)


def floor_days(purchase, delivered):
    if delivered is None:
        return None
    return math.floor((delivered - purchase).total_seconds() / 86400)


def bucket(days):
    if days is not None and days <= 3:
        return "1-3 days"
    if days is not None and days <= 7:
        return "4-7 days"
    return "8+ days"


class Brute:
    def __init__(self, t):
        self.t = t
        self.sales = []  # (order_id, product_id, price, purchase, delivered)
        for oid, _, pid, price in t["order_items"]:
            if oid is None:
                continue
            for o in t["orders"]:
                if o[0] == oid and o[2] == "delivered":
                    self.sales.append((oid, pid, price, o[3], o[4]))

    def period(self, year, month=None):
        return [
            s
            for s in self.sales
            if s[3] is not None and s[3].year == year and (month is None or s[3].month == month)
        ]

    @staticmethod
    def revenue(rows):
        return money(sum(cents(s[2]) for s in rows if s[2] is not None))

    @staticmethod
    def orders(rows):
        return len({s[0] for s in rows})

    def aov(self, rows):
        n = self.orders(rows)
        return None if n == 0 else self.revenue(rows) / n

    def monthly(self, rows):
        by = defaultdict(int)
        for s in rows:
            by[s[3].month] += cents(s[2]) if s[2] is not None else 0
        return {m: money(v) for m, v in sorted(by.items())}

    def avg_mom(self, rows):
        months = list(self.monthly(rows).values())
        growths = [(b - a) / a for a, b in zip(months, months[1:]) if a != 0]
        return sum(growths) / len(growths) if growths else None

    def category(self, rows):
        by = defaultdict(int)
        for s in rows:
            for pid, cat in self.t["products"]:
                if pid == s[1] and cat is not None and s[2] is not None:
                    by[cat] += cents(s[2])
        return {k: money(v) for k, v in by.items()}

    def state(self, rows):
        by = defaultdict(int)
        for s in rows:
            for o in self.t["orders"]:
                if o[0] != s[0]:
                    continue
                for cid, st in self.t["customers"]:
                    if cid == o[1] and st is not None and s[2] is not None:
                        by[st] += cents(s[2])
        return {k: money(v) for k, v in by.items()}

    def review_table(self, rows):
        table = set()
        for s in rows:
            days = floor_days(s[3], s[4])
            for oid, score in self.t["reviews"]:
                if oid == s[0]:
                    table.add((s[0], days, bucket(days), score))
        return table

    @staticmethod
    def mean(values):
        values = [v for v in values if v is not None]
        return sum(values) / len(values) if values else None


def spark_model(spark, t):
    schemas = table_schemas()
    return SalesModel({name: spark.createDataFrame(rows, schemas[name]) for name, rows in t.items()})


def guarded(cur, prev):
    return (cur - prev) / prev if prev is not None and prev > 0 else 0.0


@pytest.mark.parametrize("seed", range(6))
def test_metrics_match_brute_force(spark, seed):
    t = make_tables(seed)
    b = Brute(t)
    m = spark_model(spark, t)
    cur, prev = b.period(YEAR), b.period(YEAR - 1)

    k = reports.kpi_report(m, YEAR).collect()[0]
    assert k["revenue"] == b.revenue(cur)
    assert k["prev_revenue"] == b.revenue(prev)
    assert k["order_count"] == b.orders(cur)
    assert k["prev_order_count"] == b.orders(prev)
    assert k["aov"] == b.aov(cur)
    assert k["revenue_growth"] == guarded(b.revenue(cur), b.revenue(prev))
    assert k["order_growth"] == guarded(b.orders(cur), b.orders(prev))
    expected_mom = b.avg_mom(cur)
    if expected_mom is None:
        assert k["avg_monthly_growth"] is None
    else:
        assert k["avg_monthly_growth"] == pytest.approx(expected_mom, rel=1e-12)
    table = b.review_table(cur)
    assert k["avg_score"] == b.mean([r[3] for r in table])
    assert k["avg_delivery_days"] == b.mean([r[1] for r in table])
    prev_table = b.review_table(prev)
    assert k["prev_avg_delivery_days"] == b.mean([r[1] for r in prev_table])

    for sales in (m.sales, m.order_sales):
        period = filter_by_period(sales, YEAR)
        monthly = {r["month"]: r["revenue"] for r in revenue.monthly_revenue(period).collect()}
        assert monthly == b.monthly(cur)

    cats = {r["product_category_name"]: r["revenue"] for r in product.revenue_by_category(filter_by_period(m.sales, YEAR), m.products).collect()}
    assert cats == b.category(cur)
    for sales in (m.sales, m.order_sales):
        states = {r["customer_state"]: r["price"] for r in product.revenue_by_state(filter_by_period(sales, YEAR), m.orders, m.customers).collect()}
        assert states == b.state(cur)

    spark_table = experience.review_speed(experience.delivery_metrics(filter_by_period(m.sales, YEAR)), m.reviews)
    assert {tuple(r) for r in spark_table.collect()} == table
    by_bucket = {r["delivery_time"]: r["review_score"] for r in experience.score_by_bucket(spark_table).collect()}
    expected_bucket = {}
    for name in {r[2] for r in table}:
        expected_bucket[name] = b.mean([r[3] for r in table if r[2] == name])
    assert by_bucket == expected_bucket
    shares = {r["review_score"]: r["share"] for r in experience.score_distribution(spark_table).collect()}
    scores = [r[3] for r in table]
    assert shares == {s: scores.count(s) / len(scores) for s in set(scores)}

    cube = {(r["year"], r["month"]): (r["revenue"], r["order_count"]) for r in reports.period_cube(m).collect()}
    for year in (YEAR - 1, YEAR):
        rows = b.period(year)
        if rows:
            assert cube[(year, None)] == (b.revenue(rows), b.orders(rows))
        for month in range(1, 13):
            rows = b.period(year, month)
            if rows:
                assert cube[(year, month)] == (b.revenue(rows), b.orders(rows))


@pytest.mark.parametrize("seed", range(6, 9))
def test_month_kpis_match_brute_force(spark, seed):
    t = make_tables(seed)
    b = Brute(t)
    m = spark_model(spark, t)
    months = sorted({s[3].month for s in b.period(YEAR)})
    month = months[len(months) // 2] if months else 6
    cur, prev = b.period(YEAR, month), b.period(YEAR - 1, month)
    k = reports.kpi_report(m, YEAR, month).collect()[0]
    assert (k["revenue"], k["prev_revenue"]) == (b.revenue(cur), b.revenue(prev))
    assert (k["order_count"], k["prev_order_count"]) == (b.orders(cur), b.orders(prev))
    assert k["aov"] == b.aov(cur)
    assert k["aov_growth"] == guarded(b.aov(cur), b.aov(prev))
    assert k["avg_monthly_growth"] is None
    table = b.review_table(cur)
    assert k["avg_score"] == b.mean([r[3] for r in table])
    assert k["avg_delivery_days"] == b.mean([r[1] for r in table])
    s = reports.summary(m, YEAR, month).collect()[0]
    cats = b.category(cur)
    states = b.state(cur)
    top_cat = min(cats, key=lambda c: (-cats[c], c)) if cats else None
    top_state = min(states, key=lambda c: (-states[c], c)) if states else None
    assert (s["top_category"], s["top_state"]) == (top_cat, top_state)
