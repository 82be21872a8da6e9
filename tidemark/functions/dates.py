"""Date parsing dialects and calendar periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order; day before month comes before the reverse.
_STAMPS = ("yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "M/d/yyyy H:m:s")
_DATES = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy")
PERIODS = {"month": "yyyy-MM", "quarter": "yyyy-'Q'Q", "year": "yyyy"}


def normalize_date(c: Column) -> Column:
    """An ISO date, or an ISO date and time where the time isn't midnight; else the text, trimmed."""
    text = F.trim(c)
    naive = F.regexp_replace(text, r"(\.\d+)?(Z|[+-]\d\d:?\d\d)?$", "")
    stamp = F.coalesce(*(F.try_to_timestamp(naive, F.lit(f)) for f in _STAMPS), *(F.try_to_timestamp(text, F.lit(f)) for f in _DATES))
    midnight = F.date_format(stamp, "HH:mm:ss") == "00:00:00"
    return F.when(stamp.isNull(), text).when(midnight, F.date_format(stamp, "yyyy-MM-dd")).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"))


def iso_date(c: Column) -> Column:
    """The date of an ISO prefix; other dialects are null on purpose."""
    return F.to_date(F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit("yyyy-M-d")))


def panel_date(c: Column) -> Column:
    """Dates of the subscription panel; its sentinels are null."""
    text = F.trim(c)
    return F.when(~F.lower(text).isin("", "(not set)", "n/a", "-", "0000-00-00"), F.to_date(F.coalesce(
        *(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-M-d H:m:s", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy"))
    )))


def install_date(c: Column) -> Column:
    """A date in one of three forms (d/m/y first), else null."""
    text = F.trim(c)
    return F.to_date(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy"))))


def days_since(d: Column, as_of: Column) -> Column:
    """Whole days to ``as_of``, 0 for later dates."""
    return F.when(d.isNotNull(), F.greatest(F.lit(0), F.datediff(as_of, d)))


def seller_date(c: Column) -> Column:
    """The date of the first ten characters, ISO or d/m/y, else null."""
    head = F.substring(F.trim(c), 1, 10)
    return F.to_date(F.coalesce(F.try_to_timestamp(head, F.lit("yyyy-M-d")), F.try_to_timestamp(head, F.lit("d/M/yyyy"))))


_STAMP = "yyyy-MM-dd'_'HH-mm-ss'Z'"


def parse_run_stamp(c: Column) -> Column:
    """The time of a stamp like 2026-04-18_10-15-00Z, else null."""
    return F.try_to_timestamp(F.trim(c), F.lit(_STAMP)).cast("timestamp_ntz")


def run_stamp(t: Column) -> Column:
    return F.date_format(t, _STAMP)


def period_key(d: Column, period: str) -> Column:
    """2026-04, 2026-Q2 or 2026."""
    return F.date_format(d, PERIODS[period])


def period_start(d: Column, period: str) -> Column:
    return F.trunc(d, period)


def period_label(key: Column, period: str) -> Column:
    """Apr 2026 or Q2 2026; a malformed key passes through."""
    if period == "month":
        return F.coalesce(F.date_format(F.try_to_timestamp(F.concat(key, F.lit("-01")), F.lit("yyyy-MM-dd")), "MMM yyyy"), key)
    if period == "quarter":
        return F.when(key.rlike(r"^\d{4}-Q[1-4]$"), F.concat(F.substring(key, 6, 2), F.lit(" "), F.substring(key, 1, 4))).otherwise(key)
    return key


def short_period_label(key: Column, period: str) -> Column:
    """Apr/26 or Q2/26; a malformed key passes through."""
    if period == "quarter":
        return F.when(key.rlike(r"^\d{4}-Q[1-4]$"), F.concat(F.substring(key, 6, 2), F.lit("/"), F.substring(key, 3, 2))).otherwise(key)
    if period == "month":
        return F.coalesce(F.date_format(F.try_to_timestamp(F.concat(key, F.lit("-01")), F.lit("yyyy-MM-dd")), "MMM/yy"), key)
    return key


def day_label(c: Column) -> Column:
    """18 Apr 2026 of an ISO date; other text passes through."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")), "d MMM yyyy"), c)
