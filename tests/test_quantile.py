"""Exact distributed quantiles against numpy's linear interpolation."""

from __future__ import annotations

import random

import numpy as np
import pytest

from orderlens.operators.quantile import approx_quantiles, describe, exact_quantiles

PROBS = (0.25, 0.5, 0.75)


def numpy_quantiles(values):
    arr = np.array([v for v in values if v is not None], dtype=float)
    return [float(np.percentile(arr, p * 100)) for p in PROBS]


@pytest.mark.parametrize("accuracy", [2, 10, 100, 10_000])
def test_matches_numpy_with_hot_value(spark, accuracy):
    rng = random.Random(accuracy)
    n = 3000
    hot = [42.5] * (n // 3)  # one value holds a third of the rows
    spread = [round(rng.uniform(-100, 1000), 2) for _ in range(n - len(hot) - 50)]
    ints = [float(rng.randint(0, 20)) for _ in range(50)]
    a = hot + spread + ints
    rng.shuffle(a)
    b = [None if rng.random() < 0.1 else rng.randint(1, 9) for _ in range(n)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b int").repartition(7)
    got = {r["column"]: r for r in exact_quantiles(df, ["a", "b"], accuracy=accuracy).collect()}
    for col, values in (("a", a), ("b", b)):
        expected = numpy_quantiles(values)
        row = got[col]
        assert row["n"] == sum(v is not None for v in values)
        for name, want in zip(("p25", "p50", "p75"), expected):
            assert row[name] == pytest.approx(want, rel=1e-12, abs=1e-12), (col, name)


def test_edge_columns(spark):
    rows = [(7.0, 1.0, None), (7.0, None, None), (7.0, None, None)]
    df = spark.createDataFrame(rows, "const double, single double, empty double")
    got = {r["column"]: r for r in exact_quantiles(df, ["const", "single", "empty"]).collect()}
    assert (got["const"]["p25"], got["const"]["p50"], got["const"]["p75"]) == (7.0, 7.0, 7.0)
    assert (got["single"]["n"], got["single"]["p50"]) == (1, 1.0)
    assert "empty" not in got


def test_describe_layout(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, 3.5, "y"), (3, None, "z"), (4, 10.25, "w")], "i bigint, price double, s string")
    out = {r["column"]: r for r in describe(df).collect()}
    assert set(out) == {"i", "price"}
    assert out["i"]["count"] == 4 and out["i"]["mean"] == 2.5 and out["i"]["p50"] == 2.5
    assert out["price"]["count"] == 3 and out["price"]["mean"] == pytest.approx(16.25 / 3)
    assert out["price"]["min"] == 2.5 and out["price"]["max"] == 10.25 and out["price"]["p50"] == 3.5
    assert out["i"]["std"] == pytest.approx(float(np.std([1, 2, 3, 4], ddof=1)))


def test_approx_option_close_to_exact(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(0, 1000), 2) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    approx = approx_quantiles(df, ["v"]).collect()[0]
    exact = numpy_quantiles(values)
    ranks = sorted(values)
    for name, want in zip(("p25", "p50", "p75"), exact):
        # rank error of the sketch is at most n / accuracy
        got_rank = sum(v <= approx[name] for v in ranks)
        want_rank = sum(v <= want for v in ranks)
        assert abs(got_rank - want_rank) <= len(values) / 10000 + 1
    assert describe(df, exact=False).collect()[0]["count"] == 5000


@pytest.mark.parametrize("accuracy,ranges", [(2, 3), (20, 2), (200, 64)])
def test_ranges_do_not_change_the_result(spark, accuracy, ranges):
    """Values spaced exponentially, ties across range ends, NaN and missing values, many quantiles."""
    rng = random.Random(ranges)
    a = [rng.choice([2.0**k for k in range(-40, 41)] + [1.5] * 30) for _ in range(1500)] + [float("nan"), None] * 20
    b = [rng.randrange(10**6) for _ in range(len(a))]
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(list(zip(a, b)), "a double, b long").repartition(5)
    got = {r["column"]: r for r in exact_quantiles(df, ["a", "b"], probs, accuracy=accuracy, ranges=ranges).collect()}
    for name, values in (("a", [v for v in a if v is not None and v == v]), ("b", b)):
        want = [float(np.percentile(values, 100 * p)) for p in probs]
        assert list(got[name])[2:] == pytest.approx(want, rel=1e-12)


def test_no_window_or_sort_over_values_and_two_scans(spark):
    """Windows run over counted ranges only; the table is read twice."""
    from conftest import SF_SMALL
    from orderlens.plans.model import SalesModel
    from test_plans import plan_text

    items = SalesModel.from_fixtures(spark, SF_SMALL).order_items
    df = describe(items)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 2, plan
    windows = [line for line in plan_text(df).splitlines() if line.startswith("Arguments") and "windowspecdefinition" in line]
    assert windows and all("part#" in line or "ORDER" not in line and "ASC" not in line for line in windows)
