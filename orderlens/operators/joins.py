"""Joins that pair missing keys, as pandas' merge does (S16); opt-in.

Spark's equi-joins let a missing key match nothing, which is the default everywhere here.
Null-safe equality alone would send every row with a missing key to one task, however many
there are, so these rows are dealt over ``PARTS`` parts on one side and copied to each part on
the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 64
_PART = "__part"


def join_pairing_missing(dealt: DataFrame, copied: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """Inner join on ``key`` in which missing matches missing.

    Rows of ``dealt`` with a missing key go to a part by the hash of the whole row, so a task that
    runs again deals them alike; only equal rows share a part.  Rows of ``copied`` with a missing
    key are repeated once a part, so the side with fewer of them belongs there.  Rows with a
    key are neither moved nor repeated.
    """
    missing = F.col(key).isNull()
    left = dealt.withColumn(
        _PART, F.when(missing, F.pmod(F.xxhash64(*dealt.columns), F.lit(parts))).otherwise(0).cast("int")
    )
    all_parts, one_part = F.sequence(F.lit(0), F.lit(parts - 1)), F.array(F.lit(0))
    right = copied.withColumn(_PART, F.explode(F.when(missing, all_parts).otherwise(one_part)))
    right = right.withColumnsRenamed({key: "__key", _PART: "__copy"})
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col(_PART) == F.col("__copy"))
    return left.join(right, on).drop(_PART, "__key", "__copy")


def count_equal_rows(dimension: DataFrame) -> DataFrame:
    """The distinct rows with ``n_rows``, how often each occurs: what a sum over a join needs of a
    dimension, with at most one row left of each attribute under a missing key."""
    return dimension.groupBy(*dimension.columns).agg(F.count(F.lit(1)).alias("n_rows"))
