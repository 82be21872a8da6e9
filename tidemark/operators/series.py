"""Period series: counts, gap filling, growth, running and rolling totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import period_key

_STEP = {"month": "interval 1 month", "quarter": "interval 3 month", "year": "interval 1 year"}


def period_counts(df: DataFrame, group: str, date_col: str, period: str, distinct_id: str | None = None) -> DataFrame:
    """(group, start, n): rows, or distinct ids with each blank id on its own; rows without a date are left out."""
    rows = df.where(F.col(date_col).isNotNull()).withColumn("start", F.to_date(F.date_trunc(period, F.col(date_col))))
    if distinct_id is None:
        return rows.groupBy(group, "start").agg(F.count("*").alias("n"))
    key = F.nullif(F.trim(F.col(distinct_id).cast("string")), F.lit(""))
    return rows.groupBy(group, "start").agg((F.count_distinct(key) + F.count_if(key.isNull())).alias("n"))


def calendar(bounds: DataFrame, period: str) -> DataFrame:
    """Every period start from ``lo`` to ``hi`` of a one-row frame; none where they are null or reversed."""
    return bounds.where("lo <= hi").select(F.explode(F.sequence("lo", "hi", F.expr(_STEP[period]))).alias("start"))


def _on_grid(grid: DataFrame, counts: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """Counts at each cell of the grid, 0 where there are none; by grouping, so that a null key is a key like any other."""
    cells = grid.select(*keys, *(F.lit(0).alias(c) for c in fields), F.lit(True).alias("_cell"))
    both = cells.unionByName(counts.select(*keys, *fields, F.lit(False).alias("_cell")))
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in fields), F.bool_or("_cell").alias("_cell")).where("_cell").drop("_cell")


def fill_gaps(counts: DataFrame, groups: DataFrame, group: str, period: str, total: str = "all_apps") -> DataFrame:
    """(group, period, n) for every group and every period of the common span, with the sum of groups.

    The calendar is a handful of rows, and so is ``groups``; their product is the dense grid.
    """
    spine = F.broadcast(calendar(counts.agg(F.min("start").alias("lo"), F.max("start").alias("hi")), period))
    dense = _on_grid(groups.select(group).distinct().crossJoin(spine), counts, [group, "start"], "n")
    both = dense.select(group, "start", "n").unionByName(dense.groupBy("start").agg(F.sum("n").alias("n")).withColumn(group, F.lit(total)))
    return both.select(group, period_key(F.col("start"), period).alias("period"), "n")


def growth(series: DataFrame, group: str) -> DataFrame:
    """Percent change to the period before; null for the first and where that was 0. Lag comes before any filter."""
    before = F.lag("n").over(Window.partitionBy(group).orderBy("period"))
    return series.withColumn("growth_pct", 100 * F.try_divide((F.col("n") - before).cast("double"), before.cast("double")))


def cumulative(series: DataFrame, group: str) -> DataFrame:
    return series.withColumn("total", F.sum("n").over(Window.partitionBy(group).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))


def rolling(df: DataFrame, group: str, date_col: str, as_of: str, days: int = 30, lookback: int = 90) -> DataFrame:
    """(group, day, n): for each of the ``lookback`` + 1 days to ``as_of``, rows of the ``days`` days that end with it."""
    end = F.lit(as_of).cast("date")
    daily = df.withColumn("day", F.to_date(date_col)).where((F.col("day") <= end) & (F.col("day") > F.date_sub(end, lookback + days))).groupBy(group, "day").agg(F.count("*").alias("c"))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, lookback + days - 1), end)).alias("day"))
    grid = _on_grid(df.select(group).distinct().crossJoin(F.broadcast(spine)), daily, [group, "day"], "c")
    window = Window.partitionBy(group).orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)
    return grid.withColumn("n", F.sum("c").over(window)).where(F.col("day") >= F.date_sub(end, lookback)).select(group, "day", "n")


def two_series(installs: DataFrame, uninstalls: DataFrame, group: str, install_col: str, uninstall_col: str, seller: str, period: str, total: str = "all_apps") -> DataFrame:
    """(group, period, installs, uninstalls) over the common span of both, gaps filled, with the sum of groups.

    Installs count rows, uninstalls different sellers of each period.
    """
    a = period_counts(installs, group, install_col, period).select(group, "start", F.col("n").alias("installs"), F.lit(0).alias("uninstalls"))
    b = period_counts(uninstalls, group, uninstall_col, period, seller).select(group, "start", F.lit(0).alias("installs"), F.col("n").alias("uninstalls"))
    both = a.unionByName(b)
    spine = F.broadcast(calendar(both.agg(F.min("start").alias("lo"), F.max("start").alias("hi")), period))
    groups = installs.select(group).unionByName(uninstalls.select(group)).distinct()
    dense = _on_grid(groups.crossJoin(spine), both, [group, "start"], "installs", "uninstalls")
    sums = dense.groupBy("start").agg(F.sum("installs").alias("installs"), F.sum("uninstalls").alias("uninstalls")).withColumn(group, F.lit(total))
    return dense.unionByName(sums).select(group, period_key(F.col("start"), period).alias("period"), "installs", "uninstalls")


def growth_of(series: DataFrame, group: str, *columns: str) -> DataFrame:
    """Percent change of each column to the period before; null for the first and where that was 0."""
    by = Window.partitionBy(group).orderBy("period")
    return series.withColumns({f"{c}_growth_pct": 100 * F.try_divide((F.col(c) - F.lag(c).over(by)).cast("double"), F.lag(c).over(by).cast("double")) for c in columns})


def steps_by_month(df: DataFrame, group: str, date_col: str, steps: str, total: str = "all_apps") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(group, month, label, n), (group, coverage_pct) and (label), sorted.

    Rows without a date are in no month, and count in the coverage as not told.
    """
    clean = F.trim(F.coalesce(F.col(steps).cast("string"), F.lit("")))
    label = F.when(clean.isin("", "(empty)"), F.lit("(not set)")).otherwise(clean)
    rows = df.select(group, F.date_format(date_col, "yyyy-MM").alias("month"), label.alias("label"))
    counts = rows.groupBy(group, "month", "label").agg(F.count("*").alias("n"))
    counts = counts.unionByName(counts.groupBy("month", "label").agg(F.sum("n").alias("n")).withColumn(group, F.lit(total)))
    told = F.sum(F.when(F.col("month").isNotNull() & (F.col("label") != "(not set)"), F.col("n")).otherwise(0))
    coverage = counts.groupBy(group).agg((100.0 * told / F.sum("n")).cast("double").alias("coverage_pct"))
    return counts.where("month is not null"), coverage, counts.where("month is not null").select("label").distinct().orderBy("label")


def clip_periods(series: DataFrame, last: str | None, window: int = 12) -> DataFrame:
    """The ``window`` periods that end with ``last``; unchanged where it is not told or no period of the series."""
    if not last:
        return series
    periods = series.select("period").distinct()
    known = periods.where(F.col("period") == last)
    # a row for each period, of which the series has a few hundred at most
    kept = periods.where(F.col("period") <= last).orderBy(F.desc("period")).limit(window).join(F.broadcast(known.select(F.lit(True).alias("_is"))), how="cross").select("period")
    every = periods.join(F.broadcast(known.select(F.lit(True).alias("_is"))), F.lit(True), "left_anti")
    return series.join(F.broadcast(kept.unionByName(every)), "period", "left_semi")


def daily_timeline(installs: DataFrame, uninstalls: DataFrame, install_col: str, uninstall_col: str, as_of: str, days: int = 7) -> DataFrame:
    """(day, installs, uninstalls) of the ``days`` days before ``as_of`` and of itself, zeros kept."""
    end = F.lit(as_of).cast("date")
    spine = installs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days), end)).alias("day"))
    count = lambda df, c, name: df.withColumn("day", F.to_date(c)).where(F.col("day").between(F.date_sub(end, days), end)).groupBy("day").agg(F.count("*").alias(name))
    return spine.join(count(installs, install_col, "installs"), "day", "left").join(count(uninstalls, uninstall_col, "uninstalls"), "day", "left").na.fill(0, ["installs", "uninstalls"])
