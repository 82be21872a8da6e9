"""Plan classes, buckets, scores and lead buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, which results depend on: labels by which plans are classified, words of plan names and
# periods in the order they are tried.
NOT_PAID = ("", "n/a", "na", "none", "-", "(empty)", "(not set)")
FREE = ("free", "free plan", "trial", "free trial")
UNPAID = ("", "n/a", "na", "none", "free", "trial", "-", "—")
TIERS = ("enterprise plus", "enterprise", "standard", "basic", "starter", "premium", "pro", "plus", "lite", "custom", "combo", "trial", "free")
PERIOD_MONTHS = (
    ("yearly", 12), ("year subscription", 12), ("year", 12), ("annual", 12), ("half-yearly", 6), ("half yearly", 6), ("6 months", 6), ("6 month", 6),
    ("quarterly", 3), ("quaterly", 3), ("3 months", 3), ("3 month", 3), ("9 months", 9), ("9 month", 9), ("monthly", 1), ("month", 1),
)
CADENCES = {12: "Yearly", 6: "Half-Yearly", 3: "Quarterly", 1: "Monthly", 9: "9 Month"}
#: A dollar amount, with or without thousands separators.
PRICE = "[$] *([0-9][0-9,]*(?:[.][0-9]+)?)"
BUCKETS = ("0", "1-10", "11-100", "101-1k", "1k+")


def plan_class(plan: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(plan, F.lit(""))))
    return F.when(clean.isin(*NOT_PAID), "Not Paid").when(clean.isin(*FREE), "Free").otherwise("Paid")


def is_paid(plan: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(plan, F.lit("")))).isin(*UNPAID)


def count_bucket(n: Column) -> Column:
    return F.when(n < 0, "unknown").when(n == 0, "0").when(n <= 10, "1-10").when(n <= 100, "11-100").when(n <= 1000, "101-1k").otherwise("1k+")


def _first(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda acc, p: F.when(p[0], p[1]).otherwise(acc), reversed(pairs), default)


def parse_plan(plan: Column, fallback: dict[str, float] | None = None) -> Column:
    """struct(label, period_months, price_usd, monthly_usd) of a plan's text.

    The first tier and the first period that occur count. Without a period a price is
    monthly; without a price the whole text is looked up in ``fallback``.
    """
    raw = F.trim(F.coalesce(plan, F.lit("")))
    low = F.lower(raw)
    blank = low.isin("", "(not set)", "n/a", "none", "-")
    tier = _first([(low.contains(t), F.lit(t.title())) for t in TIERS], F.lit(""))
    months = _first([(low.contains(p), F.lit(n)) for p, n in PERIOD_MONTHS], F.lit(0))
    price = F.regexp_replace(F.regexp_extract(raw, PRICE, 1), ",", "").try_cast("double")
    known = _first([(low == k, F.lit(float(v))) for k, v in (fallback or {}).items()], F.lit(0.0))
    monthly = F.when(price.isNotNull() & (months > 0), price / F.greatest(months, F.lit(1))).when(price.isNotNull(), price).otherwise(known)
    cadence = _first([(months == n, F.lit(x)) for n, x in CADENCES.items()], F.lit(""))
    label = F.when(tier != "", tier).otherwise(cadence)
    return F.struct(
        F.when(blank, F.lit("")).otherwise(label).alias("label"), F.when(blank, F.lit(0)).otherwise(months).alias("period_months"),
        F.when(~blank, price).alias("price_usd"), F.when(blank, F.lit(0.0)).otherwise(F.round(monthly, 2)).alias("monthly_usd"),
    )


def _n(c: Column) -> Column:
    """A count or rate; unknown counts as 0 (``least`` alone would ignore it and give full points)."""
    return F.coalesce(c, F.lit(0))


def fit_score(paid: Column, days: Column, products: Column, orders: Column, failed: Column, steps: Column) -> Column:
    """0 to 100: readiness of free accounts to convert and of paid ones to grow; unknown inputs count as 0, an unknown plan as unpaid."""
    days, products, orders, failed, steps = map(_n, (days, products, orders, failed, steps))
    free = F.least(F.lit(35.0), days / 4.3) + F.least(F.lit(30.0), products / 20.0) + F.least(F.lit(30.0), orders * 2.0) + F.least(F.lit(5.0), steps * 1.0)
    failing = F.coalesce(F.try_divide(failed, orders), F.lit(0.0)) > 0.1
    grown = 30.0 + F.least(F.lit(50.0), orders / 10.0) + F.least(F.lit(20.0), products / 50.0) - F.when(failing, 15.0).otherwise(0.0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(F.when(paid, grown).otherwise(free)).cast("int")))


def temperature(score: Column) -> Column:
    return F.when(score >= 75, "Hot").when(score >= 50, "Warm").when(score >= 25, "Cool").otherwise("Low")


def health_score(days_since_login: Column, failure_rate: Column, onboarded: Column, days_to_expiration: Column) -> Column:
    d, e = days_since_login, days_to_expiration
    login = F.when(d.isNull(), 5).when(d <= 7, 40).when(d <= 30, 25).when(d <= 60, 12).otherwise(0)
    expiry = F.when(e.isNull(), 10).when(e >= 60, 15).when(e >= 30, 10).when(e >= 14, 5).otherwise(0)
    total = login + 30.0 * (1 - F.least(_n(failure_rate), F.lit(1.0))) + F.when(onboarded, 15).otherwise(5) + expiry
    return F.least(F.lit(100), F.rint(total).cast("int"))


def opportunity_score(orders: Column, skus: Column, age_days: Column, days_since_login: Column) -> Column:
    """Unknown counts are 0. A login today counts as none known, as in the source of these figures."""
    d = F.coalesce(F.nullif(days_since_login, F.lit(0)), F.lit(999))
    score = F.least(F.lit(40.0), 8 * F.log1p(_n(orders))) + F.least(F.lit(30.0), 5 * F.log1p(_n(skus)))
    return F.rint(score + F.when(age_days.between(30, 365), 15).when(age_days >= 7, 8).otherwise(0) + F.when(d <= 14, 15).otherwise(0)).cast("int")


def winback_score(expired: Column, history: Column, orders: Column, lapsed_days: Column) -> Column:
    lapse = F.when(lapsed_days <= 30, 30).when(lapsed_days <= 90, 22).when(lapsed_days <= 180, 15).when(lapsed_days <= 365, 8).otherwise(0)
    return F.when(expired, F.rint(F.least(F.lit(35.0), 7.0 * _n(history)) + F.least(F.lit(35.0), 6 * F.log1p(_n(orders))) + lapse).cast("int")).otherwise(0)


def lead_bucket(row: dict[str, Column]) -> Column:
    """The first bucket whose rule holds; null where none does.

    ``row`` has the columns status (purchase), installed (boolean), reinstalled (boolean),
    orders, skus, history, other_apps, failure_rate, idle_days, days_to_expiration,
    age_days and onboarding (upper case, empty where unknown).
    """
    here, status = row["installed"], row["status"]
    paying = (status == "Purchased") & here
    free = status.isin("Free Subscription", "Free Subscription Expire") & here
    rules = {
        "renewal_at_risk": paying & row["days_to_expiration"].between(0, 14),
        "trial_conversion": (status == "Trial Expired") & here & ((row["orders"] >= 1) | (row["skus"] >= 5)),
        "upgrade_ready": free & ((row["orders"] >= 10) | (row["skus"] >= 50)),
        "winback_high_value": (status == "License Expired") & ((row["orders"] >= 50) | (row["history"] >= 2)),
        "paid_idle": paying & (row["idle_days"] >= 30),
        "failure_spike": paying & (row["failure_rate"] >= 0.2) & (row["orders"] >= 10),
        "cross_sell_oldapps": here & (status != "Purchased") & (row["other_apps"] >= 1),
        "reinstall_committed": here & row["reinstalled"],
        "stuck_onboarding": here & row["age_days"].between(7, 60) & ~row["onboarding"].isin("", "COMPLETE"),
    }
    return _first([(c, F.lit(x)) for x, c in rules.items()], F.lit(None).cast("string"))
