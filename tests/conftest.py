from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from orderlens.session import COMMON_CONF, ensure_checkpoint_dir

    builder = SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[*]")).config("spark.sql.shuffle.partitions", "8")
    for k, v in COMMON_CONF.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


def ts(text: str | None):
    return None if text is None else dt.datetime.fromisoformat(text)


@pytest.fixture
def toy(spark):
    """Build the five tables from small Python row lists (string keys, as in the CSVs)."""
    from orderlens.plans.model import SalesModel
    from orderlens.sources.schemas import table_schemas

    schemas = table_schemas()

    def make(orders=(), items=(), products=(), customers=(), reviews=()):
        data = {
            "orders": [
                (o[0], o[1], o[2], ts(o[3]), ts(o[4])) for o in orders
            ],
            "order_items": list(items),
            "products": list(products),
            "customers": list(customers),
            "reviews": list(reviews),
        }
        tables = {name: spark.createDataFrame(rows, schemas[name]) for name, rows in data.items()}
        return SalesModel(tables)

    return make
