"""Exact, distributed quantiles and the numeric profile ``describe``.

Spark's exact ``percentile`` keeps a map of every distinct value of a group in one buffer,
and for a global quantile that buffer is merged in one task -- unbounded at scale.
``percentile_approx`` is bounded but not exact.  ``exact_quantiles`` computes pandas' linear
interpolation exactly, for several columns at once, as one lazy plan of two scans:

1. a bounded sketch (``percentile_approx``, rank error at most n / accuracy) brackets every
   wanted rank between two values; ``describe`` takes it in the scan of its other statistics;
2. one aggregation counts the rows below, between and above the brackets, and per distinct
   value those inside (partial aggregation: a value holding a third of all rows becomes one
   row before the shuffle): about 4 n / accuracy values a quantile;
3. a second sketch over these values, spread over all tasks, cuts them into ``RANGES`` ranges, the
   rows of every range are counted, and running counts over the ranges -- never over the values --
   tell which range holds a wanted rank;
4. the values of that range alone (a RANGES-th of step 2's) are put in order and the rank is picked.

Steps 3 and 4 read one shuffle of step 2's counts.  A wanted rank outside its bracket raises an
error; an approximate value is never returned.  Brackets, cuts and picked ranges, a bounded
number per column, are all that is broadcast.  Nothing is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import money_units_sql, money_total

DESCRIBE_PROBS = (0.25, 0.5, 0.75)


def _quantile_name(p: float) -> str:
    return f"p{round(p * 100):02d}"


# Ranges that the values inside the brackets of a column are cut into.
RANGES = 1024


def _edges(probs, accuracy: int) -> list[float]:
    """Probabilities of the ends of the brackets, two per wanted one."""
    margin = 2.0 / accuracy
    return [min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)]


def _brackets(columns: list[str], probs, accuracy: int) -> list[F.Column]:
    """One sketch per column, as aggregates; NaN is missing."""
    values = (F.expr(f"nullif(CAST(`{c}` AS DOUBLE), CAST('NaN' AS DOUBLE))") for c in columns)
    return [F.percentile_approx(v, _edges(probs, accuracy), accuracy).alias(f"{c}|q") for c, v in zip(columns, values)]


def _bracket_rows(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``column, q`` from the one row of sketches."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}|q`").alias("q")) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs=DESCRIBE_PROBS,
    accuracy: int = 10_000,
    brackets: DataFrame | None = None,
    ranges: int = RANGES,
) -> DataFrame:
    """One row per column: ``column, n, p25, p50, ...`` -- linear interpolation between the
    closest ranks (pandas / numpy default); missing values are ignored.  A column without
    values gets no row.  ``accuracy`` and ``ranges`` change the size of steps, not the result.
    ``brackets``: rows ``column, q`` of the first step, where a caller's own scan gave them."""
    if brackets is None:
        brackets = _bracket_rows(df.agg(*_brackets(columns, probs, accuracy)), columns)
    x = F.col("x")
    long_form = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "x")
        .where(x.isNotNull() & ~F.isnan(x))
    )
    margin = 2.0 / accuracy
    inside, region = F.lit(False), F.lit(0)
    for k, p in enumerate(probs):
        low = F.lit(float("-inf")) if p - margin <= 0 else F.col("q")[2 * k]
        high = F.lit(float("inf")) if p + margin >= 1 else F.col("q")[2 * k + 1]
        inside = inside | ((x >= low) & (x <= high))
        region = region + (x >= low).cast("int") + (x > high).cast("int")
    counts = (
        long_form.join(F.broadcast(brackets), "column")
        .select("column", "x", region.alias("region"), F.when(inside, x).alias("value"))
        .groupBy("column", "region", "value")
        .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"))
    )
    # rows of counts ascend by least; a row outside the brackets stands for all values of its region
    steps = ", ".join(f"{k / ranges!r}D" for k in range(1, ranges))
    # c > 0 always holds: reading c keeps this branch's aggregation like the others', one exchange
    cuts = counts.groupBy("column").agg(
        F.expr(f"percentile_approx(CASE WHEN c > 0 THEN least END, array({steps}), {10 * ranges})").alias("cuts")
    )
    placed = counts.join(F.broadcast(cuts), "column").select(
        "column", "value", "c", "least", F.expr("size(filter(cuts, s -> s < least))").alias("part")
    )
    totals = placed.groupBy("column", "part").agg(F.sum("c").alias("c"))
    # at most ``ranges`` rows a column
    below = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = totals.select(
        "column",
        "part",
        "c",
        F.sum("c").over(Window.partitionBy("column")).alias("n"),
        (F.sum("c").over(below) - F.col("c")).alias("start"),
    )
    ranks = []
    for p in probs:
        pos = f"(CAST(n - 1 AS DOUBLE) * {float(p)!r}D)"
        ranks += [f"floor({pos})", f"least(ceil({pos}), n - 1)"]
    held = " OR ".join(f"(start <= {r} AND {r} < start + c)" for r in ranks)
    picked = running.where(held).select("column", "part", "n", "start")
    # of a column at most two ranges a quantile, each of a RANGES-th of the values
    values = (
        placed.join(F.broadcast(picked), ["column", "part"])
        .groupBy("column", "n")
        .agg(F.sort_array(F.collect_list(F.struct("least", "part", "start", "value", "c"))).alias("found"))
    )

    def at(rank: str) -> str:
        """SQL for the value with a rank."""
        before = "CASE WHEN a.part = e.part THEN a.s ELSE e.start END"
        value = "coalesce(e.value, CAST(raise_error('a wanted rank lies outside its bracket') AS DOUBLE))"
        return (
            "aggregate(found, named_struct('part', -1, 's', 0L, 'x', CAST(NULL AS DOUBLE)), (a, e) -> named_struct("
            f"'part', e.part, 's', {before} + e.c, 'x', "
            f"CASE WHEN {before} <= {rank} AND {rank} < {before} + e.c THEN {value} ELSE a.x END), a -> a.x)"
        )

    picks, out = [], [F.col("column"), F.col("n")]
    for k, p in enumerate(probs):
        name = _quantile_name(p)
        lo, hi = ranks[2 * k : 2 * k + 2]
        picks += [F.expr(at(lo)).alias(f"{name}_lo"), F.expr(at(hi)).alias(f"{name}_hi")]
        # lo + (hi - lo) * t, the same interpolation as DuckDB's quantile_cont
        t = f"(CAST(n - 1 AS DOUBLE) * {float(p)!r}D - {lo})"
        out.append(F.expr(f"CASE WHEN {t} = 0 THEN {name}_lo ELSE {name}_lo + ({name}_hi - {name}_lo) * {t} END").alias(name))
    return values.select("column", "n", *picks).select(*out)


def _numeric_columns(df: DataFrame) -> list[tuple[str, str]]:
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [(c, t) for c, t in df.dtypes if t in numeric or t.startswith("decimal")]


def _exact_mean(column: str, dtype: str, money_columns) -> F.Column:
    """Mean from an exact sum where the type allows it, so it does not depend on the order in
    which partitions are added: integers as decimal(38,0), money as integer cents."""
    c = F.col(column)
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        total = F.sum(c.cast("decimal(38,0)")).cast("double")
    elif column in money_columns:
        total = money_total(money_units_sql(f"`{column}`"))
    else:
        total = F.sum(c.cast("double"))
    return F.try_divide(total, F.count(c).cast("double"))


def approx_quantiles(df: DataFrame, columns: list[str], probs=DESCRIBE_PROBS, accuracy: int = 10000) -> DataFrame:
    """Same layout as ``exact_quantiles`` from ``percentile_approx`` (rank error at most
    n / accuracy): one pass, a bounded sketch per task, no stored intermediate."""
    x = F.col("x")
    long_form = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "x"
    )
    q = F.percentile_approx(x, list(probs), accuracy)
    out = long_form.where(x.isNotNull() & ~F.isnan(x)).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), q.alias("q")
    )
    return out.select("column", "n", *[F.col("q")[i].alias(_quantile_name(p)) for i, p in enumerate(probs)])


def describe(
    df: DataFrame, columns: list[str] | None = None, money_columns=("price",), exact: bool = True
) -> DataFrame:
    """``DataFrame.describe()`` of pandas for numeric columns, one row per column:
    ``column, count, mean, std, min, p25, p50, p75, max`` (sample std, exact quartiles).

    Count, mean, std, min, max and the sketches that bracket the quartiles come from one
    aggregate over the table, unpivoted to one row per column; ``exact_quantiles`` scans it once
    more (``exact=False``: ``approx_quantiles``, for a quick look at very large tables).
    """
    cols = [(c, t) for c, t in _numeric_columns(df) if columns is None or c in columns]
    stats = ("count", "mean", "std", "min", "max")
    aggs = []
    for c, t in cols:
        aggs += [
            F.count(c).alias(f"{c}|count"),
            _exact_mean(c, t, money_columns).alias(f"{c}|mean"),
            F.stddev_samp(F.col(c).cast("double")).alias(f"{c}|std"),
            F.min(F.col(c).cast("double")).alias(f"{c}|min"),
            F.max(F.col(c).cast("double")).alias(f"{c}|max"),
        ]
    names = [c for c, _ in cols]
    accuracy = 10_000
    wide = df.agg(*aggs, *(_brackets(names, DESCRIBE_PROBS, accuracy) if exact else []))
    # one struct per column, exploded into rows: the single-row aggregate is read once
    per_column = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"`{c}|{s}`").cast("long" if s == "count" else "double").alias(s) for s in stats],
            *([F.col(f"`{c}|q`").alias("q")] if exact else []),
        )
        for c in names
    ]
    # The filter (all rows pass) keeps fields from being pruned out of the aggregate, so the
    # sketches and the statistics below read one exchange of one scan.
    basic = wide.select(F.inline(F.filter(F.array(*per_column), lambda r: r["column"].isNotNull())))
    if exact:
        quartiles = exact_quantiles(df, names, accuracy=accuracy, brackets=basic.select("column", "q"))
    else:
        quartiles = approx_quantiles(df, names)
    quartiles = quartiles.drop("n")
    # The quartile side holds one row per column: bounded by the column count.
    return basic.join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )
