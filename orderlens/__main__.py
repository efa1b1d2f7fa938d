"""Run the period reports from the command line (``python -m orderlens`` or spark-submit).

    python -m orderlens --data ecommerce_data --year 2023 [--month 3] [--comparison-year 2022]
                        [--format csv|parquet] [--multi-line] [--lenient] [--facts DIR]
                        [--changed-orders FILE] [--bucketed DIR] [--buckets N]
                        [--out DIR] [--profile local|cluster]

Without ``--out`` each report is shown on the console; with it every report is written as
parquet under ``DIR/<report>`` (a shared folder on a cluster).  ``--facts`` names a folder of
stored facts: they are written there on the first run and opened on later ones, so a period
report reads its own months instead of joining all items and orders again.  With
``--changed-orders`` (parquet, or CSV with a header, column order_id) the months that these
orders touch are brought up to date first.  ``--bucketed`` stores the tables bucketed by their join keys
on the first run and opens them from there on later ones.
"""

from __future__ import annotations

import argparse
import os

from .operators import experience, profile
from .operators.sales import filter_by_period
from .plans import reports
from .plans.model import FACTS, SalesModel
from .session import get_spark
from .sources.bucketed import has_layout, save_bucketed


def build_reports(model: SalesModel, year: int, month: int | None, comparison_year: int | None):
    period_orders = filter_by_period(model.order_sales, year, month)
    review_table = experience.review_speed(experience.delivery_metrics(period_orders), model.reviews)
    out = {
        "kpi": reports.kpi_report(model, year, month),
        "summary": reports.summary(model, year, month, comparison_year),
        "monthly_trend": reports.monthly_trend(model, year),
        "top_categories": reports.top_categories(model, year, month, n=10),
        "revenue_by_state": reports.state_revenue(model, year, month),
        "score_by_bucket": experience.score_by_bucket(review_table),
        "score_distribution": reports.score_distribution_labeled(model, year, month),
        "order_status_share": profile.order_status_share(model.orders, year),
    }
    if month is None:
        out["monthly_growth"] = reports.monthly_growth_report(model, year)
    return out


def _stored(spark, path: str) -> bool:
    """Whether all facts have been written under ``path``."""
    from pyspark.errors import AnalysisException

    try:
        for name in FACTS:
            spark.read.parquet(os.path.join(path, name))
    except AnalysisException:
        return False
    return True


def read_order_ids(spark, path: str, model: SalesModel):
    """The ``order_id`` column of a parquet or CSV file, in the type the orders have."""
    found = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return found.select(found["order_id"].cast(model.orders.schema["order_id"].dataType).alias("order_id"))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="orderlens", description=__doc__.splitlines()[0])
    ap.add_argument("--data", required=True, help="directory with the five tables")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--year", type=int, required=True)
    ap.add_argument("--month", type=int, default=None)
    ap.add_argument("--comparison-year", type=int, default=None)
    ap.add_argument("--out", default=None, help="write each report as parquet under this folder")
    ap.add_argument("--multi-line", action="store_true", help="CSV fields may hold line breaks")
    ap.add_argument("--lenient", action="store_true", help="malformed fields are missing, not errors")
    ap.add_argument("--facts", default=None, help="folder of stored facts, written if it has none")
    ap.add_argument("--changed-orders", default=None, help="order ids whose rows changed since --facts was written")
    ap.add_argument("--bucketed", default=None, help="folder of tables bucketed by join key, written if it has none")
    ap.add_argument("--buckets", type=int, default=200, help="number of buckets when --bucketed is written")
    ap.add_argument("--profile", default="local", choices=["local", "cluster"])
    args = ap.parse_args(argv)

    spark = get_spark("orderlens-reports", profile=args.profile)
    options = {"strict": not args.lenient, "multi_line": args.multi_line} if args.format == "csv" else {}
    model = SalesModel.from_files(spark, args.data, fmt=args.format, **options)
    if args.bucketed:
        if not has_layout(spark, args.bucketed):
            save_bucketed(model.tables, args.bucketed, args.buckets)
        model = SalesModel.from_bucketed(spark, args.bucketed)
    if args.facts:
        if not _stored(spark, args.facts):
            model = model.materialize(args.facts)
        elif args.changed_orders:
            model = model.refresh(args.facts, read_order_ids(spark, args.changed_orders, model))
        else:
            model = model.with_materialized(args.facts)
    for name, df in build_reports(model, args.year, args.month, args.comparison_year).items():
        if args.out:
            df.write.mode("overwrite").parquet(os.path.join(args.out, name))
        else:
            print(f"== {name}")
            df.show(truncate=False)


if __name__ == "__main__":
    main()
