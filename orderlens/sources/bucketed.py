"""The five tables stored in buckets of their join keys.

Items, orders and reviews are bucketed by ``order_id`` into the same number of buckets, products by
``product_id``, customers by ``customer_id``.  A join or aggregation on a bucketed key reads
bucket by bucket and needs no exchange: the shuffle is paid once, when the tables are written.

A bucket is read by one task.  So a table whose largest bucket exceeds ``SKEW`` times the mean
(an order holding a third of all items) is stored plain: its joins shuffle, and adaptive
execution splits the hot key.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES

KEYS = {
    "orders": "order_id", "order_items": "order_id", "reviews": "order_id", "products": "product_id",
    "customers": "customer_id",
}
SKEW = 4.0
# Buckets smaller than this are never worth a shuffle, however uneven.
SMALL_BUCKET_ROWS = 100_000
LAYOUT = "layout.parquet"


def _table_name(data_dir: str, name: str) -> str:
    return f"orderlens_{hashlib.md5(os.path.abspath(data_dir).encode()).hexdigest()[:12]}_{name}"


def bucket_id(key: str, buckets: int) -> F.Column:
    """The bucket Spark puts a key into."""
    return F.pmod(F.hash(key), F.lit(buckets))


def uneven(df: DataFrame, key: str, buckets: int) -> bool:
    """Whether the largest bucket would hold more than ``SKEW`` times the mean."""
    sizes = df.groupBy(bucket_id(key, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return most is not None and most > max(SKEW * total / buckets, SMALL_BUCKET_ROWS)


def save_bucketed(tables: dict[str, DataFrame], out_dir: str, buckets: int, mode: str = "errorifexists") -> None:
    """Store the tables under ``out_dir`` (a shared folder) as parquet with ``buckets`` buckets.

    One shuffle on the key deals the rows, so each bucket is one file.  The layout (table, key,
    number of buckets; 0 for a plain table) is stored beside them for :func:`load_bucketed`."""
    spark = next(iter(tables.values())).sparkSession
    layout = []
    for name in TABLES:
        key, path = KEYS[name], os.path.join(out_dir, name)
        if uneven(tables[name], key, buckets):
            tables[name].write.mode(mode).parquet(path)
            layout.append((name, key, 0))
            continue
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(out_dir, name)}")
        dealt = tables[name].repartition(buckets, key)
        dealt.write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_table_name(out_dir, name))
        layout.append((name, key, buckets))
    rows = spark.createDataFrame(layout, "name string, key string, buckets int").coalesce(1)
    rows.write.mode(mode).parquet(os.path.join(out_dir, LAYOUT))


def has_layout(spark: SparkSession, data_dir: str) -> bool:
    try:
        spark.read.parquet(os.path.join(data_dir, LAYOUT))
    except AnalysisException:
        return False
    return True


def load_bucketed(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """The tables that :func:`save_bucketed` stored, in this or an earlier session."""
    out = {}
    for name, key, buckets in spark.read.parquet(os.path.join(data_dir, LAYOUT)).collect():
        path, table = os.path.join(data_dir, name), _table_name(data_dir, name)
        plain = spark.read.parquet(path)
        if not buckets:
            out[name] = plain
            continue
        # external tables: dropping one forgets the definition and keeps the files
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
        location = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        out[name] = spark.table(table)
    return out
