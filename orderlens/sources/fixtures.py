"""The five source tables derived from the driver's TPC-H-like parquet files (FIXTURES.md).

The production data (five CSVs) is not shipped, so the test and bench inputs are views over
``orders``, ``lineitem``, ``part``, ``customer`` and ``nation``.  The mapping deliberately
adds hours to both timestamps (floor days differ from calendar days), leaves one delivery
date in fifteen missing, turns one brand into a missing category and builds several review
rows per order.  ``FIXTURE_SQL_DUCKDB`` is the same mapping for the DuckDB oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import session_key

# ---------------------------------------------------------------------------
# Fixed values of the fixture mapping (FIXTURES.md)
# ---------------------------------------------------------------------------
STATUS_MAP = {"F": "delivered", "O": "shipped"}  # any other status -> "processing"
OTHER_STATUS = "processing"
NO_CATEGORY_BRAND = "Brand#13"
DELIVERY_CYCLE = 15  # n = (o_orderkey*7 + o_custkey) % 15; n == 14 -> no delivery date
NO_REVIEW_CYCLE = 7  # orders with (o_orderkey / 4) % 7 == 6 get review ids that match no order
# ---------------------------------------------------------------------------


# Read handles per (application, file): like a catalog table, a source DataFrame is
# resolved once (file listing, footer schema) and reused by every query of the session.
_HANDLES: dict[tuple[str, str], DataFrame] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (session_key(spark), path)
    if key not in _HANDLES:
        _HANDLES[key] = spark.read.parquet(path)
    return _HANDLES[key]


def fixture_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % DELIVERY_CYCLE
    status = F.when(F.col("o_orderstatus") == "F", F.lit(STATUS_MAP["F"])).when(
        F.col("o_orderstatus") == "O", F.lit(STATUS_MAP["O"])
    ).otherwise(F.lit(OTHER_STATUS))
    purchase = F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate"))
    delivered = F.when(
        n < DELIVERY_CYCLE - 1,
        F.timestamp_add(
            "DAY", n, F.timestamp_add("HOUR", F.col("o_custkey") % 24, F.col("o_orderdate"))
        ),
    )
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        delivered.alias("order_delivered_customer_date"),
    )


def fixture_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").alias("price"),
    )


def fixture_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.nullif(F.col("p_brand"), F.lit(NO_CATEGORY_BRAND)).alias("product_category_name"),
    )


def fixture_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    # nation is the fixed 25-row TPC-H dimension at every scale factor: a proven size bound,
    # so broadcasting it never grows with the data.
    nation = F.broadcast(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return c.join(nation, c["c_nationkey"] == nation["n_nationkey"]).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("n_name").alias("customer_state"),
    )


def fixture_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    # one review row per line item; the negative ids leave some orders without a review
    order_id = F.expr(f"CASE WHEN (l_orderkey div 4) % {NO_REVIEW_CYCLE} = {NO_REVIEW_CYCLE - 1} THEN -l_orderkey ELSE l_orderkey END")
    return li.select(
        order_id.alias("order_id"),
        (F.lit(1) + F.col("l_partkey") % 5).cast("int").alias("review_score"),
    )


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five tables under the reference's names, as lazy DataFrames."""
    return {
        "orders": fixture_orders(spark, sf_dir),
        "order_items": fixture_items(spark, sf_dir),
        "products": fixture_products(spark, sf_dir),
        "customers": fixture_customers(spark, sf_dir),
        "reviews": fixture_reviews(spark, sf_dir),
    }


# The same mapping as DuckDB common table expressions over the driver's views.
FIXTURE_SQL_DUCKDB = """
fx_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                       ELSE 'processing' END AS order_status,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS order_purchase_timestamp,
    CASE WHEN (o_orderkey*7 + o_custkey) % 15 < 14 THEN
      o_orderdate + to_hours(CAST(o_custkey % 24 AS BIGINT))
                  + to_days(CAST((o_orderkey*7 + o_custkey) % 15 AS INTEGER))
    END AS order_delivered_customer_date
  FROM orders),
fx_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
         l_partkey AS product_id, l_extendedprice AS price FROM lineitem),
fx_products AS (
  SELECT p_partkey AS product_id, nullif(p_brand, 'Brand#13') AS product_category_name
  FROM part),
fx_customers AS (
  SELECT c_custkey AS customer_id, n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
fx_reviews AS (
  SELECT CASE WHEN (l_orderkey // 4) % 7 = 6 THEN -l_orderkey ELSE l_orderkey END AS order_id,
         CAST(1 + l_partkey % 5 AS INT) AS review_score
  FROM lineitem)
"""
