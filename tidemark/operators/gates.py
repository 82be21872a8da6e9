"""Data-quality gates of a run, the worst verdict of each (app, kind), and promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("ok", "pending_review", "blocked")


def level(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), status) - 1


def status_of(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), level.cast("int") + 1)


def normal_label(c: Column) -> Column:
    """Lower case, white space trimmed and collapsed."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def grid_check(observed: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """(group, missing, unexpected, status) of column labels.

    ``observed`` (group, label), ``expected`` (group, label, required). A required label that
    is not there blocks, one that nobody expects asks for a review. Labels are compared in
    lower case, with white space collapsed. Groups that were not observed are left out.
    """
    seen = observed.select(group, normal_label(F.col("label")).alias("name")).distinct()
    known = expected.groupBy(group, normal_label(F.col("label")).alias("name")).agg(F.max("required").alias("required"))
    both = seen.withColumn("seen", F.lit(True)).join(known.join(seen.select(group).distinct(), group, "left_semi"), [group, "name"], "full_outer")
    lists = both.groupBy(group).agg(
        F.sort_array(F.collect_list(F.when(F.col("seen").isNull() & F.col("required"), F.col("name")))).alias("missing"),
        F.sort_array(F.collect_list(F.when(F.col("required").isNull(), F.col("name")))).alias("unexpected"),
    )
    return lists.withColumn("status", F.when(F.size("missing") > 0, "blocked").when(F.size("unexpected") > 0, "pending_review").otherwise("ok"))


def pagination_check(trace: DataFrame, group: str, scraped: DataFrame | None = None, tolerance: float = 0.05) -> DataFrame:
    """(group, out_of_order, repeated, empty_inside, off, status) of page traces (pos from 1, page_num, first_key, rows, reported).

    Blocked where pages are not numbered 1, 2, 3 and so on in the order they came, a first
    key comes twice, a page before the last is empty, or the rows differ from the largest
    reported total by more than ``tolerance``. Rows come from ``scraped`` (group, scraped), else
    from the pages. Blank first keys and missing totals say nothing.
    """
    key = F.when(F.col("first_key").cast("string") != "", F.col("first_key"))
    pages = trace.groupBy(group).agg(
        F.count_if(~F.col("page_num").eqNullSafe(F.col("pos"))).alias("out_of_order"), (F.count(key) - F.count_distinct(key)).alias("repeated"),
        (F.count_if(F.col("rows") == 0) - F.max_by(F.when(F.col("rows") == 0, 1).otherwise(0), "pos")).alias("empty_inside"), F.sum("rows").alias("on_pages"), F.max("reported").alias("total"),
    )
    rows = F.col("on_pages")
    if scraped is not None:
        pages, rows = pages.join(scraped, group, "left"), F.coalesce("scraped", F.lit(0))
    off = F.when(F.col("total") > 0, F.abs(rows - F.col("total")).cast("double") / F.col("total"))
    bad = (F.col("out_of_order") > 0) | (F.col("repeated") > 0) | (F.col("empty_inside") > 0) | F.coalesce(off > tolerance, F.lit(False))
    return pages.select(group, "out_of_order", "repeated", "empty_inside", off.alias("off"), F.when(bad, "blocked").otherwise("ok").alias("status"))


def row_drop_check(current: DataFrame, previous: DataFrame, keys: list[str], soft: float = 0.2, hard: float = 0.5) -> DataFrame:
    """(keys, rows, before, drop, status) by (app, kind); nothing before is ok."""
    a, b = (df.select(*keys, F.lit(i).alias("_now")) for i, df in ((1, current), (0, previous)))
    both = a.unionByName(b).groupBy(*keys).agg(F.sum("_now").alias("rows"), F.sum(1 - F.col("_now")).alias("before"))
    drop = F.when(F.col("before") > 0, F.greatest(F.lit(0.0), (F.col("before") - F.col("rows")).cast("double") / F.col("before")))
    return both.withColumn("drop", drop).withColumn("status", F.when(F.col("drop") > hard, "blocked").when(F.col("drop") > soft, "pending_review").otherwise("ok"))


def verdicts(checks: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, status, failed): the worst status of each key over named checks (keys, status), and which were not ok."""
    every = reduce(DataFrame.unionByName, [df.select(*keys, F.lit(name).alias("check"), "status") for name, df in checks.items()])
    out = every.groupBy(*keys).agg(F.max(level(F.col("status"))).alias("level"), F.sort_array(F.collect_set(F.when(F.col("status") != "ok", F.col("check")))).alias("failed"))
    return out.select(*keys, status_of(F.col("level")).alias("status"), "failed")


def promoted(current: DataFrame, latest: DataFrame, verdict: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the new latest rows, the staged rows).

    A blocked (app, kind) keeps its latest rows, and its fresh ones are staged; the other kind
    of the app goes ahead. One with another verdict gives way to its fresh rows, also where
    there are none. What this run did not touch stays.
    """
    blocked = verdict.where("status = 'blocked'").select(*keys).distinct()
    fresh = current.join(blocked, keys, "left_anti")
    judged = verdict.where("status <> 'blocked'").select(*keys)
    kept = latest.join(fresh.select(*keys).unionByName(judged).distinct(), keys, "left_anti")
    return fresh.unionByName(kept, allowMissingColumns=True), current.join(blocked, keys, "left_semi")


def merged_errors(current: DataFrame, latest: DataFrame, touched: DataFrame, app: str) -> DataFrame:
    """Errors of this run, and the latest ones of apps that it did not touch."""
    return current.unionByName(latest.join(touched.select(app).distinct(), app, "left_anti"))


def stale_diff(report: DataFrame, group: str, total: str = "all_apps") -> DataFrame:
    """(stale, empty_apps): all rows are new and none churned because nothing was there before, and the apps of which that holds.

    ``report`` is ``run_report``, a row an app and one of totals.
    """
    hollow = (F.col("previous") == 0) & (F.col("current") > 0) & (F.col("new_installs") == F.col("current")) & (F.col("churned_sellers") == 0)
    return report.agg(
        F.coalesce(F.bool_or(F.when(F.col(group) == total, hollow)), F.lit(False)).alias("stale"),
        F.sort_array(F.collect_list(F.when((F.col(group) != total) & (F.col("previous") == 0) & (F.col("current") > 0), F.col(group)))).alias("empty_apps"),
    )
