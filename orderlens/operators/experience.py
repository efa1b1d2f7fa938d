"""Delivery and review metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BUCKET_BOUNDS, BUCKET_LABELS, bucket_order, delivery_bucket, floor_days
from .sales import DELIVERED_TS, PURCHASE_TS

REVIEW_COLUMNS = ("order_id", "delivery_speed", "delivery_time", "review_score")


def delivery_metrics(sales: DataFrame, bounds=BUCKET_BOUNDS, labels=BUCKET_LABELS) -> DataFrame:
    """Adds ``delivery_speed`` (floor days, S5) and ``delivery_time`` (bucket, S6/S7).
    Bucket bounds and labels are parameters; the defaults are the reference's."""
    return sales.withColumn("delivery_speed", floor_days(PURCHASE_TS, DELIVERED_TS)).withColumn(
        "delivery_time", delivery_bucket("delivery_speed", bounds, labels)
    )


def known_scores(reviews: DataFrame) -> DataFrame:
    """Reviews with NaN scores as NULL: a column of whole scores with a missing one arrives as
    double with NaN from a pandas export, and NaN is missing there (S3)."""
    if dict(reviews.dtypes)["review_score"] not in ("float", "double"):
        return reviews
    return reviews.withColumn("review_score", F.expr("nullif(review_score, CAST('NaN' AS DOUBLE))"))


def review_speed(sales_with_delivery: DataFrame, reviews: DataFrame) -> DataFrame:
    """Distinct ``(order_id, delivery_speed, delivery_time, review_score)`` of the sales
    that have a review (A9, S21, S22).

    Both sides are de-duplicated before the join.  The set of distinct joined rows equals the
    join of the two distinct sets, and the pre-dedupe runs as a partial aggregation, so a hot
    order with many line items or review rows is reduced to a few rows before any shuffle.
    The final dedupe reuses the join's ``order_id`` partitioning.
    """
    left = sales_with_delivery.select("order_id", "delivery_speed", "delivery_time").dropDuplicates()
    right = known_scores(reviews.select("order_id", "review_score")).dropDuplicates()
    return left.join(right, "order_id").select(*REVIEW_COLUMNS).dropDuplicates()


def review_summary(review_table: DataFrame) -> DataFrame:
    """``avg_score`` (A10) and ``avg_delivery_speed`` (A11) in one pass; missing delivery
    days are skipped by the mean (S3)."""
    return review_table.agg(
        F.avg("review_score").alias("avg_score"),
        F.avg("delivery_speed").alias("avg_delivery_speed"),
    )


def score_distribution(review_table: DataFrame) -> DataFrame:
    """Share of each review score among non-missing scores, sorted by score.

    The share window runs over the per-score counts -- one row per distinct score.
    """
    counts = review_table.where(F.col("review_score").isNotNull()).groupBy("review_score").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(
        "review_score", (F.col("n") / total).alias("share")
    ).orderBy("review_score")


def score_by_bucket(review_table: DataFrame, labels=BUCKET_LABELS) -> DataFrame:
    """Mean score per delivery bucket in bucket order."""
    return (
        review_table.where(F.col("delivery_time").isNotNull())
        .groupBy("delivery_time")
        .agg(F.avg("review_score").alias("review_score"))
        .withColumn("bucket_ord", bucket_order("delivery_time", labels))
        .orderBy("bucket_ord")
    )


def score_by_delivery_day(review_table: DataFrame) -> DataFrame:
    """Mean score per exact delivery day; missing days are dropped."""
    return (
        review_table.where(F.col("delivery_speed").isNotNull())
        .groupBy("delivery_speed")
        .agg(F.avg("review_score").alias("review_score"))
        .orderBy("delivery_speed")
    )


def review_metrics(sales_with_delivery: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """The reference's review bundle, every entry a lazy DataFrame."""
    table = review_speed(sales_with_delivery, reviews)
    summary = review_summary(table)
    return {
        "review_speed_df": table,
        "avg_score": summary.select("avg_score"),
        "score_distribution": score_distribution(table),
        "score_by_delivery_bucket": score_by_bucket(table),
        "avg_delivery_speed": summary.select("avg_delivery_speed"),
    }
