"""

Reading with a declared schema avoids the extra pass and the unstable result of schema
inference.  Only the columns the metrics read are declared; ``tables.read_csv`` finds them by
name in each file's header, so files may carry more columns in any order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
# Logical table name -> CSV file name in the data directory.
CSV_FILES = {
    "orders": "orders_dataset.csv",
    "order_items": "order_items_dataset.csv",
    "products": "products_dataset.csv",
    "customers": "customers_dataset.csv",
    "reviews": "order_reviews_dataset.csv",
}
# ---------------------------------------------------------------------------

TABLES = tuple(CSV_FILES)


def _schema(fields, key_type: T.DataType) -> T.StructType:
    out = []
    for name, dtype in fields:
        out.append(T.StructField(name, key_type if dtype == "key" else dtype, True))
    return T.StructType(out)


def table_schemas(key_type: T.DataType = T.StringType()) -> dict[str, T.StructType]:
    """Schemas of the five tables.  Identifiers are opaque keys: strings in the production
    CSVs, ``bigint`` in the parquet fixtures."""
    ts = T.TimestampNTZType()
    return {
        "orders": _schema(
            [
                ("order_id", "key"),
                ("customer_id", "key"),
                ("order_status", T.StringType()),
                ("order_purchase_timestamp", ts),
                ("order_delivered_customer_date", ts),
            ],
            key_type,
        ),
        "order_items": _schema(
            [
                ("order_id", "key"),
                ("order_item_id", T.IntegerType()),
                ("product_id", "key"),
                ("price", T.DoubleType()),
            ],
            key_type,
        ),
        "products": _schema(
            [("product_id", "key"), ("product_category_name", T.StringType())],
            key_type,
        ),
        "customers": _schema(
            [("customer_id", "key"), ("customer_state", T.StringType())],
            key_type,
        ),
        "reviews": _schema(
            [("order_id", "key"), ("review_score", T.IntegerType())],
            key_type,
        ),
    }
