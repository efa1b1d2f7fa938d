"""Column expressions shared by every metric.

All of them are built-in Spark SQL expressions, so they stay inside whole-stage codegen;
none is a Python UDF.  Each one pins down a pandas behaviour the metrics must keep (the

Every helper takes column names or SQL fragments (``"price"``, ``"sum(key_revenue)"``,
``"lag(revenue) OVER (ORDER BY month)"``) and comes in two forms: ``*_sql`` returns SQL
text to compose further, the plain name returns a Column built with one ``F.expr`` call.
One parsed expression costs a single round trip to the JVM, where the same expression built
operator by operator through the Column API costs dozens -- the difference dominates plan
construction time of the larger reports.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
DELIVERED_STATUS = "delivered"
# Delivery-speed buckets: label and inclusive upper bound in days; the last is open.
BUCKET_LABELS = ("1-3 days", "4-7 days", "8+ days")
BUCKET_BOUNDS = (3, 7)
# Currency label thresholds and suffixes: >= 1,000,000 -> "M" with one decimal,
# >= 1,000 -> "K" with no decimal, otherwise the plain value with no decimal.
CURRENCY_SYMBOL = "$"
MILLION = 1_000_000
THOUSAND = 1_000
# ---------------------------------------------------------------------------

# Money is exact to 10**-MONEY_SCALE.  The scale is one internal constant, so units made in
# one place are read the same way everywhere; a price with more decimals raises an error.
MONEY_SCALE = 4
# From here on doubles are coarser than a unit, so a price cannot have finer decimals.
_COARSE_MONEY = 2.0**53 / 10**MONEY_SCALE
MICROS_PER_DAY = 86_400_000_000


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# -- money -------------------------------------------------------------------


def money_units_sql(c: str) -> str:
    price, unit = f"CAST({c} AS DOUBLE)", f"{float(10**MONEY_SCALE)}D"
    return (
        f"CASE WHEN {price} IS NULL OR isnan({price}) THEN CAST(NULL AS BIGINT) "
        f"WHEN abs({price}) >= {_COARSE_MONEY}D OR rint({price} * {unit}) / {unit} = {price} "
        f"THEN CAST(rint({price} * {unit}) AS BIGINT) "
        f"ELSE raise_error('a price has more than {MONEY_SCALE} decimals') END"
    )


def money_units(c: str) -> Column:
    """A price as an exact integer count of units of 10**-MONEY_SCALE (section 1.4).

    Sums of these longs are exact and do not depend on partition order.  A missing price,
    NaN included, gives NULL.  A price that is no whole number of units raises an error
    rather than being rounded.  ``rint(x * 10**scale)`` equals ``cast(x as decimal)`` scaled,
    and costs a multiply instead of the decimal cast's string round trip.
    """
    return F.expr(money_units_sql(c))


def units_to_money_sql(units: str) -> str:
    return f"CAST(CAST({units} AS DECIMAL(38,0)) / CAST({10**MONEY_SCALE} AS DECIMAL(38,0)) AS DOUBLE)"


def units_to_money(units: str) -> Column:
    """Exact integer units back to the public ``double`` money type, correctly rounded."""
    return F.expr(units_to_money_sql(units))


def wide_sum_sql(units: str) -> str:
    """Sum of BIGINT units as DECIMAL(38,0), 0 for no rows: beyond the range of a long, at the
    cost of two long sums (of the units' high and low parts) instead of a decimal per row."""
    u = f"CAST({units} AS BIGINT)"
    return (
        f"(CAST(coalesce(sum(shiftright({u}, 20)), 0) AS DECIMAL(25,0)) * CAST(1048576 AS DECIMAL(7,0)) + "
        f"CAST(coalesce(sum({u} & 1048575), 0) AS DECIMAL(25,0)))"
    )


def units_sum_sql(units: str) -> str:
    return f"coalesce(sum({units}), CAST(0 AS BIGINT))"


def units_sum(units: str) -> Column:
    """Exact sum of money units as a long, for groups such as an order or a product; no rows or
    only missing prices give 0 (S1).  Totals over such groups use ``wide_sum_sql``."""
    return F.expr(units_sum_sql(units))


def money_total_sql(units: str) -> str:
    return units_to_money_sql(wide_sum_sql(units))


def money_total(units: str) -> Column:
    """Exact sum of money units returned as double; no rows give 0.0."""
    return F.expr(money_total_sql(units))


def money_sum(c: str) -> Column:
    """Exact sum of a double price column, returned as double."""
    return money_total(money_units_sql(c))


# -- ratios and growth -----------------------------------------------------------


def safe_ratio_sql(num: str, den: str) -> str:
    return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def safe_ratio(num: str, den: str) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI division would throw; S9, S10)."""
    return F.expr(safe_ratio_sql(num, den))


def growth(current: str, previous: str) -> Column:
    """Unguarded period-over-period growth, (cur - prev) / prev; zero base -> NULL."""
    cur, prev = f"CAST({current} AS DOUBLE)", f"CAST({previous} AS DOUBLE)"
    return F.expr(f"try_divide({cur} - {prev}, {prev})")


def guarded_growth(current: str, previous: str) -> Column:
    """Dashboard growth: 0.0 unless the previous value is positive."""
    cur, prev = f"CAST({current} AS DOUBLE)", f"CAST({previous} AS DOUBLE)"
    return F.expr(f"CASE WHEN {prev} > 0 THEN ({cur} - {prev}) / {prev} ELSE 0.0D END")


# -- delivery ----------------------------------------------------------------------


def floor_days(start: str, end: str) -> Column:
    """Whole elapsed 24-hour periods, floored also for negative spans.

    Not ``datediff`` (calendar days) and not ``timestampdiff(DAY)`` (truncates to zero).
    Missing end gives NULL.
    """
    micros = f"timestampdiff(MICROSECOND, {start}, {end})"
    return F.expr(f"CAST(floor({micros} / {float(MICROS_PER_DAY)}D) AS INT)")


def delivery_bucket(days: str, bounds=BUCKET_BOUNDS, labels=BUCKET_LABELS) -> Column:
    """Bucket label: the first bucket whose inclusive upper bound holds ``days``, else the
    last (open) one.  No lower bound (S7); a missing value falls to the last bucket (S6).
    ``len(labels) == len(bounds) + 1``."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("need one label per bound plus one for the open bucket")
    cases = " ".join(f"WHEN {days} <= {bound} THEN {_quote(label)}" for bound, label in zip(bounds, labels))
    return F.expr(f"CASE {cases} ELSE {_quote(labels[-1])} END")


def bucket_order(label: str, labels=BUCKET_LABELS) -> Column:
    """Position of a bucket label (1, 2, 3, ...) for ordered sorting (T4)."""
    cases = " ".join(f"WHEN {label} = {_quote(name)} THEN {pos}" for pos, name in enumerate(labels, start=1))
    return F.expr(f"CASE {cases} END")


# -- labels ------------------------------------------------------------------------


def month_name_sql(month: str, short: bool = False) -> str:
    pattern = "MMM" if short else "MMMM"
    return f"date_format(make_date(2020, CAST({month} AS INT), 1), '{pattern}')"


def month_name(month: str, short: bool = False) -> Column:
    """Full (``January``) or short (``Jan``) English month name of a month number."""
    return F.expr(month_name_sql(month, short))


def period_label(year: str, month: str | None = None) -> Column:
    """``'2000'`` for a full year, ``'March 2000'`` for a month."""
    y = f"CAST({year} AS STRING)"
    if month is None:
        return F.expr(y)
    return F.expr(f"CASE WHEN {month} IS NULL THEN {y} ELSE concat_ws(' ', {month_name_sql(month)}, {y}) END")


def _fixed(x: str, decimals: int) -> str:
    # format_number with a pattern rounds half-even on the binary value like Python's
    # format spec and adds no thousands separators.
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    return f"format_number({x}, '{pattern}')"


def currency_label(value: str) -> Column:
    """``$2.1M`` / ``$300K`` / ``$85``; negative values stay unscaled (F1)."""
    v = f"CAST({value} AS DOUBLE)"
    sym = _quote(CURRENCY_SYMBOL)
    return F.expr(
        f"CASE WHEN {v} >= {MILLION} THEN concat({sym}, {_fixed(f'{v} / {MILLION}', 1)}, 'M') "
        f"WHEN {v} >= {THOUSAND} THEN concat({sym}, {_fixed(f'{v} / {THOUSAND}', 0)}, 'K') "
        f"ELSE concat({sym}, {_fixed(v, 0)}) END"
    )


def round_half_even(value: str, decimals: int = 2) -> Column:
    """Python ``round(x, n)`` on a float: half-even on the binary value."""
    return F.expr(f"CAST({_fixed(f'CAST({value} AS DOUBLE)', decimals)} AS DOUBLE)")


def trend_columns(growth_col: str, inverted: bool = False, prefix: str = "") -> list[Column]:
    """Trend indicator parts (F2): direction, good/bad, absolute percent with 2 decimals."""
    pct = f"({growth_col}) * 100"
    up = f"({pct} >= 0)"
    good = f"NOT {up}" if inverted else up
    return [
        F.expr(f"CASE WHEN {up} THEN 'up' WHEN {pct} IS NOT NULL THEN 'down' END").alias(f"{prefix}trend_dir"),
        F.expr(good).alias(f"{prefix}trend_good"),
        F.expr(_fixed(f"abs({pct})", 2)).alias(f"{prefix}trend_pct"),
    ]


def score_label(score: str) -> Column:
    """``'1 star'`` / ``'4 stars'``."""
    return F.expr(f"concat(CAST(CAST({score} AS INT) AS STRING), ' star', CASE WHEN {score} > 1 THEN 's' ELSE '' END)")
