"""The delivered-sales fact (O5-O10, J1) at two grains, and the period filter.

``build_sales_data`` is the reference's fact: one row per delivered line item.

``build_order_sales`` is the same fact pre-aggregated to one row per order before the join:
line items are summed per ``order_id`` (map-side partial aggregation, so a hot order with
millions of lines collapses before the shuffle) and joined to the delivered orders.  It keeps
the column names of the line-item fact -- ``price`` is the order total -- so every metric that
does not need ``product_id`` gives the same answer on either grain, with a fraction of the
shuffle volume.  Its output stays hash-partitioned by ``order_id``, so later per-order
aggregations need no further exchange.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DELIVERED_STATUS, money_units_sql, units_sum, units_to_money
from .joins import join_pairing_missing

PURCHASE_TS = "order_purchase_timestamp"
DELIVERED_TS = "order_delivered_customer_date"

SALES_COLUMNS = (
    "order_id",
    "order_item_id",
    "product_id",
    "price",
    "order_status",
    PURCHASE_TS,
    DELIVERED_TS,
    "month",
    "year",
)


def price_units(sales: DataFrame) -> str:
    """SQL for the exact money units of a sales frame's ``price``: the stored
    ``price_units`` of the order grain, or the line price converted."""
    return "price_units" if "price_units" in sales.columns else money_units_sql("price")


def parse_timestamps(df: DataFrame, columns=(PURCHASE_TS, DELIVERED_TS), lenient: bool = False) -> DataFrame:
    """Text timestamps -> ``timestamp_ntz`` (O7).  Typed columns pass through unchanged.

    Strict parsing raises on malformed text, as pandas does (S19); ``lenient`` gives NULL.
    Missing values stay NULL either way.
    """
    types = dict(df.dtypes)
    out = df
    for c in columns:
        if c in types and types[c] == "string":
            conv = F.try_to_timestamp(F.col(c)) if lenient else F.to_timestamp_ntz(F.col(c))
            out = out.withColumn(c, conv.cast(T.TimestampNTZType()))
    return out


def _orders_meta(orders: DataFrame, status: str | None, extra=(), lenient: bool = False) -> DataFrame:
    o = parse_timestamps(
        orders.select("order_id", *extra, "order_status", PURCHASE_TS, DELIVERED_TS), lenient=lenient
    )
    if status is not None:
        o = o.where(F.col("order_status") == status)
    return o


def _with_period_columns(df: DataFrame) -> DataFrame:
    ts = F.col(PURCHASE_TS)
    return df.withColumn("month", F.month(ts)).withColumn("year", F.year(ts))


def build_sales_data(
    order_items: DataFrame,
    orders: DataFrame,
    status: str | None = DELIVERED_STATUS,
    lenient: bool = False,
    pair_missing: bool = False,
) -> DataFrame:
    """Delivered line items with order metadata, ``month`` and ``year``.

    Inner equi-join on ``order_id`` (S15-S17); the status filter lands on the orders side
    below the join.  ``status=None`` keeps every status; ``lenient`` reads malformed text
    timestamps as missing instead of raising.  ``pair_missing`` lets a missing order id match a
    missing one, as pandas' merge does (S16).
    """
    items = order_items.select("order_id", "order_item_id", "product_id", "price")
    meta = _orders_meta(orders, status, lenient=lenient)
    joined = join_pairing_missing(items, meta, "order_id") if pair_missing else items.join(meta, "order_id")
    return _with_period_columns(joined).select(*SALES_COLUMNS)


def build_order_sales(
    order_items: DataFrame,
    orders: DataFrame,
    status: str | None = DELIVERED_STATUS,
    carry_customer: bool = False,
    lenient: bool = False,
) -> DataFrame:
    """Delivered sales at order grain: ``order_id, price (order total), price_units (the same
    total in exact integer units), n_items, order_status, timestamps, month, year``.

    Equal to ``build_sales_data`` grouped by the orders row: an orders row with at least one
    line item becomes one row.  Duplicate orders rows stay separate rows, exactly as they
    multiply in the line-item join.  ``carry_customer`` adds the row's ``customer_id`` (see
    ``revenue_by_state(assume_unique_orders=True)``).
    """
    totals = order_items.groupBy("order_id").agg(
        units_sum(money_units_sql("price")).alias("price_units"),
        F.count(F.lit(1)).alias("n_items"),
    )
    extra = ("customer_id",) if carry_customer else ()
    joined = totals.join(_orders_meta(orders, status, extra, lenient), "order_id")
    return _with_period_columns(joined).select(
        "order_id",
        *extra,
        units_to_money("price_units").alias("price"),
        "price_units",
        "n_items",
        "order_status",
        PURCHASE_TS,
        DELIVERED_TS,
        "month",
        "year",
    )


def _ts_literal(value: dt.datetime) -> str:
    return "TIMESTAMP_NTZ '" + value.strftime("%Y-%m-%d %H:%M:%S") + "'"


def period_range(year: int, month: int | None = None) -> tuple[dt.datetime, dt.datetime]:
    """Half-open purchase-time range of a year or a month."""
    if month is None:
        return dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    start = dt.datetime(year, month, 1)
    end = dt.datetime(year + (month == 12), month % 12 + 1, 1)
    return start, end


def period_predicate(year: int, month: int | None = None, ts_col: str | None = PURCHASE_TS) -> Column:
    """``year == y [and month == m]``, plus the same period as a timestamp range.

    ``year(ts) = y`` is only a residual filter for the parquet reader; the range on the raw
    timestamp column is pushed to the scan (row-group skipping) and to the orders side of
    every join.  Both are equivalent, so the result does not change (R3).
    """
    cond = f"year = {int(year)}"
    if month is not None:
        cond += f" AND month = {int(month)}"
    if ts_col is not None:
        start, end = period_range(year, month)
        cond += f" AND {ts_col} >= {_ts_literal(start)} AND {ts_col} < {_ts_literal(end)}"
    return F.expr(cond)


def filter_by_period(df: DataFrame, year: int, month: int | None = None) -> DataFrame:
    """Rows of a year, or of one month of it (O10).  Rows with a missing purchase time match
    no period (S20)."""
    ts_col = PURCHASE_TS if PURCHASE_TS in df.columns else None
    return df.where(period_predicate(year, month, ts_col))
