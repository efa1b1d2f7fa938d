"""Table loading (O1) and row counts (O2).

``load_datasets`` returns a ``dict`` of lazy DataFrames with the same five keys as the
reference.  CSV is read by column name with declared types (no inference pass); parquet keeps its own
schema and gets column pruning and predicate pushdown for free.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import CSV_FILES, TABLES, table_schemas


# ---------------------------------------------------------------------------
# Fields that the analysed project's CSV reader takes as missing
# ---------------------------------------------------------------------------
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
# ---------------------------------------------------------------------------


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    strict: bool = True,
    timestamp_format: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """The declared columns of a CSV file, found by name in its header.

    The header (one line is read) gives the file's layout; every column is read as text, and
    the declared ones are picked by name and converted, so further columns and any order do
    no harm.  A declared column that the header lacks raises an error.  Other files of a
    folder must have the same header (``enforceSchema`` off).  Fields in MISSING_WORDS are
    NULL.  Quotes inside quoted fields may be doubled or not; line breaks inside them need
    ``multi_line``, which keeps a file from being split among tasks: convert large data once
    with ``save_datasets``.
    """
    options = {
        "header": True, "escape": '"', "multiLine": multi_line, "mode": "FAILFAST" if strict else "PERMISSIVE",
        "nullValue": "", "emptyValue": "",
    }
    names = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in its header {names}")
    layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = spark.read.options(**options).option("enforceSchema", False).schema(layout).csv(path)
    words = ", ".join(_sql_text(w) for w in MISSING_WORDS)
    cast = "cast" if strict else "try_cast"
    out = []
    for f in schema.fields:
        field = f"CASE WHEN `{f.name}` IN ({words}) THEN NULL ELSE `{f.name}` END"
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)) and timestamp_format:
            parse = "to_timestamp_ntz" if strict else "try_to_timestamp"
            field = f"{parse}({field}, {_sql_text(timestamp_format)})"
        out.append(F.expr(f"{cast}({field} AS {f.dataType.simpleString()})").alias(f.name))
    return text.select(*out)


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def load_datasets(
    spark: SparkSession,
    data_dir: str,
    fmt: str = "csv",
    schemas: dict[str, T.StructType] | None = None,
    strict: bool = True,
    timestamp_format: str | None = None,
    multi_line: bool = False,
) -> dict[str, DataFrame]:
    """Load orders, order_items, products, customers and reviews.

    ``fmt='csv'``: files named as in ``CSV_FILES`` with a header row, read by column name (see
    :func:`read_csv`).  ``strict`` fails on text that does not parse as the declared type
    (pandas raises on bad timestamps, S19); ``strict=False`` turns such fields into NULL.
    ``fmt='parquet'``: ``<data_dir>/<table>.parquet`` (or a directory of that name).
    """
    out: dict[str, DataFrame] = {}
    if fmt == "csv":
        schemas = schemas or table_schemas()
        for name in TABLES:
            path = os.path.join(data_dir, CSV_FILES[name])
            out[name] = read_csv(spark, path, schemas[name], strict, timestamp_format, multi_line)
    elif fmt == "parquet":
        for name in TABLES:
            df = spark.read.parquet(os.path.join(data_dir, f"{name}.parquet"))
            if schemas:
                df = df.select([F.col(f.name).cast(f.dataType) for f in schemas[name].fields])
            out[name] = df
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return out


def scan_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table (``len(df)``), one row per table: ``table_name, row_count``."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def save_datasets(tables: dict[str, DataFrame], out_dir: str, mode: str = "errorifexists") -> None:
    """Store the five tables as typed parquet (``<out_dir>/<table>.parquet``).

    Converting the CSVs once pays their parse cost a single time; later loads with
    ``fmt='parquet'`` get column pruning, predicate pushdown and splittable files.
    """
    for name in TABLES:
        tables[name].write.mode(mode).parquet(os.path.join(out_dir, f"{name}.parquet"))
