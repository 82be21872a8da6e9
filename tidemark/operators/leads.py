"""Ordered lead lists. Every order ends with the key, so that ties have one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tier of each lead bucket.
TIERS = {
    "renewal_at_risk": "Hot", "trial_conversion": "Hot", "upgrade_ready": "Hot", "winback_high_value": "Hot", "cross_sell_oldapps": "Warm",
    "paid_idle": "Warm", "failure_spike": "Warm", "stuck_onboarding": "Cool", "reinstall_committed": "Cool",
}
#: What each overlapping list is ordered by, largest first.
ORDERS = {"priority": "days", "free_with_orders": "orders", "heavy_catalogue": "products", "upsell": "orders", "churn_risk": "failed"}


def ordered_list(rows: DataFrame, rule: str, key: str, top: int | None = None) -> DataFrame:
    """Rows (a column ``rule``) of one rule in its order, all of them or the first ``top``."""
    out = rows.where(F.col("rule") == rule).orderBy(F.desc(ORDERS[rule]), key)
    return out if top is None else out.limit(top)


def risk_list(df: DataFrame, key: str, top: int = 25) -> DataFrame:
    """Paying rows with revenue (installed, paying, mrr, health) by what is at risk: revenue times missing health."""
    risk = F.round(F.col("mrr") * (100 - F.col("health")), 1)
    return df.where("installed and paying and mrr > 0").withColumn("risk", risk).orderBy(F.desc("risk"), key).limit(top)


def lead_rank(row: dict[str, Column]) -> Column:
    """By what rows of a lead bucket are ordered, largest first (columns bucket, orders, skus, mrr, days_to_expiration, idle_days, failure_rate, opportunity, winback)."""
    orders, mrr = F.coalesce(row["orders"], F.lit(0)), F.coalesce(row["mrr"], F.lit(0.0))
    # an expiration today counts as unknown here, as in the source of these figures
    days = F.coalesce(F.nullif(row["days_to_expiration"], F.lit(0)), F.lit(999))
    by = {
        "renewal_at_risk": mrr * 1000 + (30 - F.greatest(F.lit(0), days)) * 10, "trial_conversion": orders + F.coalesce(row["skus"], F.lit(0)) * 0.5, "upgrade_ready": row["opportunity"],
        "winback_high_value": row["winback"], "paid_idle": mrr * 100 + F.coalesce(row["idle_days"], F.lit(0)), "failure_spike": row["failure_rate"] * F.coalesce(F.nullif(orders, F.lit(0)), F.lit(1)),
    }
    return F.coalesce(*(F.when(row["bucket"] == b, c.cast("double")) for b, c in by.items()), orders.cast("double"))


def lead_summary(df: DataFrame) -> DataFrame:
    """What a lead's line shows: common columns, and those of its bucket, null for all other buckets."""
    b = F.col("bucket")
    only = lambda value, *buckets: F.when(b.isin(*buckets), value)
    paying = ("renewal_at_risk", "paid_idle", "failure_spike")
    growing = ("upgrade_ready", "trial_conversion", "cross_sell_oldapps")
    plan = F.when(b.isin(*paying), F.substring("plan", 1, 35)).when(b.isin(*growing), F.substring("plan", 1, 30))
    return df.select(
        "bucket", "seller_id", F.coalesce("country", F.lit("—")).alias("country"), "orders", "skus", only(F.round("mrr", 2), *paying).alias("mrr"), plan.alias("plan"), only(F.col("health"), *paying).alias("health"),
        only(F.col("days_to_expiration"), "renewal_at_risk").alias("days_to_expiry"), only(F.col("idle_days"), "paid_idle").alias("days_since_login"), only(F.round(100 * F.col("failure_rate"), 1), "failure_spike").alias("failure_pct"),
        only(F.col("opportunity"), *growing).alias("opportunity"), only(F.col("winback"), "winback_high_value").alias("winback"), only(F.col("history"), "winback_high_value").alias("plan_history"),
        only(F.col("other_apps"), "cross_sell_oldapps").alias("other_apps"), only(F.col("onboarding"), "stuck_onboarding").alias("onboarding"), only(F.col("age_days"), "stuck_onboarding").alias("days_since_install"),
    )


def rep_table(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """What a rep sees of rows with ``insight``: priority, fit, some columns (blank where missing) and the days since install."""
    cell = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c)
    days = F.coalesce(F.nullif(F.col("insight.days_since_install"), F.lit(0)).cast("string"), F.lit("—"))
    return df.select(F.col("insight.temperature").alias("priority"), F.col("insight.fit_score").alias("fit"), *map(cell, columns), days.alias("days_installed"))


def bucket_tiers(df: DataFrame) -> DataFrame:
    """(tier, n) of rows with a lead bucket; all three tiers, zeros kept."""
    tier = F.coalesce(*(F.when(F.col("bucket") == b, t) for b, t in TIERS.items()))
    return df.agg(*(F.count_if(tier == t).alias(t) for t in ("Hot", "Warm", "Cool"))).unpivot([], ["Hot", "Warm", "Cool"], "tier", "n")


def temperature_counts(df: DataFrame, temperature: str) -> DataFrame:
    """(tier, n) with zeros kept."""
    names = ["Hot", "Warm", "Cool", "Low"]
    return df.agg(*(F.count_if(F.col(temperature) == t).alias(t) for t in names)).unpivot([], names, "tier", "n")


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """(status, n) over all rows, the most frequent first; blank is (not set)."""
    name = F.coalesce(F.nullif(F.col(status), F.lit("")), F.lit("(not set)"))
    return df.groupBy(name.alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def focus_period(series: DataFrame, month: str | None = None, year: int | None = None) -> DataFrame:
    """(app, installs, uninstalls) of one month, else of a year, else of the latest month of a series (app, period, installs, uninstalls)."""
    last = series.agg(F.max("period").alias("last"))
    chosen = series.where(F.col("period") == month) if month else series.where(F.col("period").startswith(f"{year:04d}")) if year else series.join(F.broadcast(last), F.col("period") == F.col("last"))
    return chosen.groupBy("app").agg(F.sum("installs").alias("installs"), F.sum("uninstalls").alias("uninstalls"))


def visible_growth(growth: DataFrame, year: int | None = None) -> DataFrame:
    """Growth rows to show: with a year that one and the one before; the changes were computed before, over all periods."""
    return growth if year is None else growth.where(F.substring("period", 1, 4).isin(f"{year:04d}", f"{year - 1:04d}"))


def recent_departures(departures: DataFrame, accounts: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """Departures (key, left_on) of some days, one row a key, by the orders of the account, largest first."""
    rows = departures.where(F.to_date("left_on").between(F.lit(since).cast("date"), F.lit(until).cast("date"))).groupBy(key).agg(F.min("left_on").alias("left_on"))
    return rows.join(accounts.select(key, "orders"), key, "left").withColumn("orders", F.coalesce("orders", F.lit(0))).orderBy(F.desc("orders"), key)


def recent_installs(accounts: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """Accounts installed in some days, the latest first."""
    return accounts.where(F.col("installed_d").between(F.lit(since).cast("date"), F.lit(until).cast("date"))).select(key, "installed_d").orderBy(F.desc("installed_d"), key)
