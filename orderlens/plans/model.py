"""``SalesModel``: the five tables plus the two lazily built sales facts.

This is the Spark counterpart of the dashboard's cached base load (O3): build it once, ask it
for any period.  ``persist`` caches tables and facts for interactive use; ``materialize``
writes the facts as parquet partitioned by ``year, month`` into a shared folder, so later
period queries prune whole directories instead of joining again; ``refresh`` rewrites only the
months that changed orders touch.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DELIVERED_STATUS
from ..operators.product import build_customer_sales
from ..operators.revenue import build_order_cells
from ..operators.sales import build_order_sales, build_sales_data
from ..session import checkpoint_table
from ..sources.bucketed import load_bucketed
from ..sources.fixtures import fixture_tables
from ..sources.tables import load_datasets

# Line grain, order grain, customer grain, and one row per month.
FACTS = ("sales", "order_sales", "customer_sales", "order_cells")
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _fact_schema(fact: DataFrame) -> T.StructType:
    """A fact's schema, with its partition columns last as parquet folders give them."""
    fields = {f.name: f for f in fact.schema.fields}
    parts = [fields.pop(c) for c in ("year", "month")]
    return T.StructType([*fields.values(), *parts])


def _write_fact(fact: DataFrame, path: str, mode: str, **options) -> None:
    dealt = fact.hint("rebalance", "year", "month")
    dealt.write.mode(mode).options(**options).partitionBy("year", "month").parquet(path)


def _in_months(months: list[tuple]) -> Column:
    """Predicate over the partition columns; months of missing purchase times are NULL."""
    lines = [" AND ".join(f"{c} <=> {'NULL' if v is None else int(v)}" for c, v in zip(("year", "month"), m)) for m in months]
    return F.expr(" OR ".join(f"({line})" for line in lines))


def _drop_month(spark: SparkSession, folder: str, month: tuple) -> None:
    """Remove the folder of a month without rows (a dynamic overwrite leaves it as it is)."""
    year, number = (NULL_PARTITION if v is None else v for v in month)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/year={year}/month={number}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass
class SalesModel:
    tables: dict[str, DataFrame]
    status: str | None = DELIVERED_STATUS
    lenient: bool = False  # malformed text timestamps are missing instead of an error
    _cache: dict[str, DataFrame] = field(default_factory=dict, repr=False)
    _kept: frozenset[str] = field(default=frozenset(), repr=False)

    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str) -> "SalesModel":
        return cls(fixture_tables(spark, sf_dir))

    @classmethod
    def from_files(cls, spark: SparkSession, data_dir: str, fmt: str = "csv", **kw) -> "SalesModel":
        return cls(load_datasets(spark, data_dir, fmt=fmt, **kw))

    @classmethod
    def from_bucketed(cls, spark: SparkSession, data_dir: str) -> "SalesModel":
        """Tables stored by ``save_bucketed``: items, orders and reviews join on ``order_id``
        without an exchange."""
        return cls(load_bucketed(spark, data_dir))

    # -- tables ---------------------------------------------------------------
    @property
    def orders(self) -> DataFrame:
        return self.tables["orders"]

    @property
    def order_items(self) -> DataFrame:
        return self.tables["order_items"]

    @property
    def products(self) -> DataFrame:
        return self.tables["products"]

    @property
    def customers(self) -> DataFrame:
        return self.tables["customers"]

    @property
    def reviews(self) -> DataFrame:
        return self.tables["reviews"]

    # -- facts ----------------------------------------------------------------
    @property
    def sales(self) -> DataFrame:
        """Line-item grain (``build_sales_data``)."""
        if "sales" not in self._cache:
            self._cache["sales"] = build_sales_data(self.order_items, self.orders, self.status, self.lenient)
        return self._cache["sales"]

    @property
    def order_sales(self) -> DataFrame:
        """Order grain, pre-aggregated before the join (``build_order_sales``)."""
        if "order_sales" not in self._cache:
            self._cache["order_sales"] = build_order_sales(
                self.order_items, self.orders, self.status, lenient=self.lenient
            )
        return self._cache["order_sales"]

    @property
    def customer_sales(self) -> DataFrame:
        """Customer grain (``build_customer_sales``)."""
        if "customer_sales" not in self._cache:
            self._cache["customer_sales"] = build_customer_sales(self.order_sales, self.orders)
        return self._cache["customer_sales"]

    @property
    def order_cells(self) -> DataFrame:
        """One row per month with revenue and a sketch of its orders (``build_order_cells``)."""
        if "order_cells" not in self._cache:
            self._cache["order_cells"] = build_order_cells(self.order_sales)
        return self._cache["order_cells"]

    def keeps(self, fact: str) -> bool:
        """Whether a fact is stored or cached rather than computed by each query."""
        return fact in self._kept

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "SalesModel":
        """Cache the tables and facts and materialise them once (the dashboard's cached
        load).  For interactive use on data that fits the cluster's memory and disk; at
        100 TB prefer ``materialize`` into the shared folder."""
        self.tables = {name: df.persist(level) for name, df in self.tables.items()}
        self._cache.clear()
        for name in FACTS:
            self._cache[name] = getattr(self, name).persist(level)
        self._kept = frozenset(FACTS)
        for df in [*self.tables.values(), *self._cache.values()]:
            df.count()
        return self

    def materialize(self, path: str, mode: str = "overwrite") -> "SalesModel":
        """Write the facts partitioned by year and month under ``path`` (a shared folder on
        a cluster) and read them back.  Returns a model whose facts are the stored tables.

        The ``rebalance`` hint clusters rows by (year, month) so each task writes few
        directories, and lets AQE split a month holding a large share of the rows into
        advisory-size tasks and merge small ones -- no rows are dropped and the layout is
        deterministic.  The coarser facts are built from the stored order grain."""
        source = SalesModel(self.tables, self.status, self.lenient)
        for name in FACTS:
            _write_fact(getattr(source, name), os.path.join(path, name), mode)
            source = source.with_materialized(path, FACTS[: FACTS.index(name) + 1])
        return source

    def with_materialized(self, path: str, facts=FACTS) -> "SalesModel":
        """This model's tables with the facts that ``materialize`` stored under ``path``.  The
        first two must be there; later ones that a folder lacks are computed when asked for."""
        spark = self.orders.sparkSession
        model = SalesModel(self.tables, self.status, self.lenient)
        for name in facts:
            plan = getattr(model, name)
            try:
                stored = spark.read.schema(_fact_schema(plan)).parquet(os.path.join(path, name))
            except AnalysisException:
                if name in FACTS[:2]:
                    raise
                continue
            model._cache[name] = stored.select(*plan.columns)
            model._kept |= {name}
        return model

    def refresh(self, path: str, changed: DataFrame) -> "SalesModel":
        """Bring the facts stored under ``path`` up to this model's tables, when only the orders
        in ``changed`` (column ``order_id``) have new, altered or removed rows in orders or items.

        Touched are the months in which such an order had or has sales.  Their new rows are the
        stored ones of all other orders and the sales of the changed orders alone, so items and
        orders are joined for these ids only; months not touched keep their files.  An order whose
        owners change is touched in all its months.  The coarser facts follow from the touched
        months of the order grain.  New rows are staged in the checkpoint folder before any month
        is overwritten; a month left without sales loses its folder.
        """
        spark = self.orders.sparkSession
        stored = SalesModel(self.tables, self.status, self.lenient).with_materialized(path)
        ids = checkpoint_table(changed.select("order_id").where("order_id IS NOT NULL").distinct(), "changed-orders")
        only = {name: self.tables[name].join(ids, "order_id", "left_semi") for name in ("orders", "order_items")}
        part = SalesModel({**self.tables, **only}, self.status, self.lenient)
        fresh = {}
        for name in FACTS[:2]:
            fresh[name] = checkpoint_table(getattr(part, name), f"changed-{name}")
        # at most one row per month of the data
        months = (
            stored.order_sales.join(ids, "order_id", "left_semi").select("year", "month")
            .unionByName(fresh["order_sales"].select("year", "month"))
            .distinct().collect()
        )
        touched = [(r.year, r.month) for r in months]
        if not touched:
            return stored
        staged = {}
        for name in FACTS[:2]:
            others = getattr(stored, name).where(_in_months(touched)).join(ids, "order_id", "left_anti")
            rows = others.select(*fresh[name].columns).unionByName(fresh[name])
            staged[name] = checkpoint_table(rows, f"staged-{name}")
        staged["customer_sales"] = build_customer_sales(staged["order_sales"], self.orders)
        staged["order_cells"] = build_order_cells(staged["order_sales"])
        for name, rows in staged.items():
            folder = os.path.join(path, name)
            if name in FACTS[2:]:
                rows = checkpoint_table(rows, f"staged-{name}")
            held = {(r.year, r.month) for r in rows.select("year", "month").distinct().collect()}
            _write_fact(rows, folder, "overwrite", partitionOverwriteMode="dynamic")
            for month in touched:
                if month not in held:
                    _drop_month(spark, folder, month)
        return SalesModel(self.tables, self.status, self.lenient).with_materialized(path)

    @classmethod
    def from_materialized(
        cls, spark: SparkSession, path: str, data_dir: str, fmt: str = "parquet", **kw
    ) -> "SalesModel":
        """Open stored facts in a new session: no join of items and orders is run again.  The
        five tables (for products, customers, reviews) are loaded from ``data_dir``."""
        return cls.from_files(spark, data_dir, fmt=fmt, **kw).with_materialized(path)
