"""Reports as Markdown, from aggregates of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import day_label, period_label
from tidemark.functions.scores import plan_class
from tidemark.functions.text import platform_slug
from tidemark.operators import segments, series
from tidemark.operators.rows import exclude_internal

PERIODS = ("month", "quarter", "year")
DIMENSIONS = ("plan", "steps", "country", "platforms")


def delta_markdown(report: DataFrame, platforms: DataFrame, run_stamp: str, previous_stamp: str | None) -> str:
    """The run-over-run report: totals, a line for each app, platforms by count.

    ``report`` is ``with_total`` of delta counts, ``platforms`` (app, platform, n); both
    have a row for each app or platform. Without a previous run, or where nothing at all
    differs from it, a banner says so.
    """
    rows = {r["app"]: r for r in report.collect()}
    total = rows.pop("all_apps")
    lines = [f"# Run {run_stamp}", ""]
    if previous_stamp is None or total["previous"] == 0:
        lines += ["> No previous run to compare with; every row counts as new.", ""]
    elif total["new"] == total["churned"] == 0:
        lines += ["> Nothing differs from the previous run; its snapshot may be stale.", ""]
    lines += [f"Total {total['current']}, before {total['previous']}, new {total['new']}, churned {total['churned']}, net {total['net_growth']:+d}.", "", "| app | current | new | churned | churn rate |", "|---|---:|---:|---:|---:|"]
    lines += [f"| {a} | {r['current']} | {r['new']} | {r['churned']} | {r['churn_rate']:.1%} |" for a, r in sorted(rows.items())]
    lines += ["", "## Platforms", ""]
    lines += [f"- {r['platform']}: {r['n']}" for r in platforms.groupBy("platform").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "platform").collect()]
    return "\n".join(lines) + "\n"


def stakeholder_report(sellers: DataFrame, uninstalls: DataFrame, as_of: str, emails: tuple[str, ...] = (), domains: tuple[str, ...] = (), exclude: bool = True) -> dict[str, DataFrame]:
    """All figures of the report by name, each a DataFrame that is computed when it is asked for.

    ``sellers`` (app, seller_id, installed_d, plan, steps, country, platforms, orders, failed,
    products), ``uninstalls`` (app, seller_id, platform, left_on), both normalised. Internal
    rows leave unless ``exclude`` is false.
    """
    if exclude:
        sellers, uninstalls = (exclude_internal(df, emails, domains) for df in (sellers, uninstalls))
    out: dict[str, DataFrame] = {}
    for period in PERIODS:
        counts = series.two_series(sellers, uninstalls, "app", "installed_d", "left_on", "seller_id", period)
        out[period] = series.growth_of(counts, "app", "installs", "uninstalls")
    monthly = out["month"].select("app", "period", F.col("installs").alias("n"))
    out["installs_cumulative"] = series.cumulative(monthly, "app")
    out |= {f"by_{d}": segments.breakdown(sellers, "app", d) for d in DIMENSIONS if d in sellers.columns}
    out["paid"] = segments.with_sums(segments.class_counts(sellers, "app", plan_class(F.col("plan")), ["Paid", "Free", "Not Paid"]), "app")
    out["steps_by_month"], out["steps_coverage"], _ = series.steps_by_month(sellers, "app", "installed_d", "steps")
    out["activity"] = segments.with_sums(segments.activity(sellers, "app"), "app")
    out["order_buckets"] = segments.bucket_counts(sellers, "app", "orders")
    out["product_activity"] = segments.product_activity(sellers, "app")
    out["activity_by_class"] = segments.activity_by_class(sellers, "app", plan_class(F.col("plan")))
    out["velocity"] = series.rolling(sellers, "app", "installed_d", as_of)
    split = uninstalls.groupBy("app", F.when(platform_slug(F.trim(F.col("platform"))) == "unknown", "(empty)").otherwise(F.trim(F.col("platform"))).alias("platform")).agg(F.count("*").alias("n"))
    out["uninstall_platforms"] = split.unionByName(split.groupBy("platform").agg(F.sum("n").alias("n")).withColumn("app", F.lit("all_apps")))
    return out


def _table(df: DataFrame, columns: list[str], limit: int | None = None) -> list[str]:
    """A Markdown table of the rows that have a figure other than 0."""
    rows = df.select(*columns) if limit is None else df.select(*columns).limit(limit)
    shown = [r for r in rows.collect() if any(v for v in r if not isinstance(v, str))]
    cell = lambda v: "" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v)
    return [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns), *(f"| {' | '.join(map(cell, r))} |" for r in shown)]


def stakeholder_markdown(report: dict[str, DataFrame], run_stamp: str, months: int = 12, top: int = 15) -> str:
    """The report over all apps, as text; periods without any figure are left out.

    Each table is collected after a limit, or has a row for each app or class.
    """
    spark = report["paid"].sparkSession
    day = spark.range(1).select(day_label(F.lit(run_stamp[:10])).alias("d")).first()["d"]
    lines = [f"# Report of {day}", "", f"Run {run_stamp}", "", "## Plans", "", *_table(report["paid"].orderBy("app"), ["app", "paid", "free", "not_paid", "total"])]
    for period in PERIODS:
        rows = report[period].where("app = 'all_apps'").orderBy(F.desc("period")).limit(months).withColumn("when", period_label(F.col("period"), period))
        lines += ["", f"## By {period}", "", *_table(rows, ["when", "installs", "installs_growth_pct", "uninstalls", "uninstalls_growth_pct"])]
    lines += ["", "## Activity", "", *_table(report["activity"].orderBy("app"), ["app", "active", "zero", "with_failed", "orders", "failed", "total"])]
    lines += ["", "## Products", "", *_table(report["product_activity"].orderBy("app"), ["app", "active", "zero", "products", "total"])]
    for d in (d for d in DIMENSIONS if f"by_{d}" in report):
        rows = report[f"by_{d}"].where("app = 'all_apps'").orderBy(F.desc("n"), "label")
        lines += ["", f"## By {d}", "", *_table(rows, ["label", "n"], top)]
    lines += ["", "## Uninstalls by platform", "", *_table(report["uninstall_platforms"].where("app = 'all_apps'").orderBy(F.desc("n"), "platform"), ["platform", "n"], top)]
    return "\n".join(lines) + "\n"


def schema_lines(kind: str, status: str, missing: list[str], extra: list[str]) -> list[str]:
    """The section of one kind's columns, from ``store.schema_status``."""
    lines = ["", f"## Columns of {kind}", "", f"Status: {status}"]
    lines += ["", "Missing, the rows are not merged:", *(f"- {c}" for c in missing)] if missing else []
    lines += ["", "Unknown, to be reviewed:", *(f"- {c}" for c in extra)] if extra else []
    return lines if missing or extra else [*lines, "", "All required columns are there, and no others."]


def validation_markdown(verdicts: DataFrame, run_stamp: str, schemas: dict[str, tuple[str, list[str], list[str]]] | None = None) -> str:
    """The verdict of each (app, kind, status, failed), the worst first, and whether the run as a whole was promoted.

    ``schemas`` has ``store.schema_status`` of kinds whose columns are reported too.
    """
    order = {"blocked": 0, "pending_review": 1, "ok": 2}
    rows = sorted(verdicts.collect(), key=lambda r: (order[r["status"]], r["app"], r["kind"]))
    worst = rows[0]["status"] if rows else "ok"
    lines = [f"# Validation of run {run_stamp}", "", f"Status: {worst}", ""]
    lines += [f"- {r['app']} / {r['kind']}: {r['status']}" + (f" ({', '.join(r['failed'])})" if r["failed"] else "") for r in rows]
    blocked = [r for r in rows if r["status"] == "blocked"]
    lines += ["", f"{len(blocked)} of {len(rows)} keep their latest rows."]
    for kind, found in (schemas or {}).items():
        lines += schema_lines(kind, *found)
    return "\n".join(lines) + "\n"
