"""Differences of two snapshots: new, churned and retained keys, change events, guarded joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import is_paid

ORDER_SPIKE = (5, 0.5)
FAILED_SPIKE = 3


def keep_one(df: DataFrame, keys: list[str], *order: Column, last: bool = False) -> DataFrame:
    """The first row of each key in an explicit order, or with ``last`` the last one; null keys are a key.

    Nulls come first in the order. An aggregate of one row a key, so that a key with very
    many rows is combined where they lie and none is sorted.
    """
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    one = df.groupBy(*keys).agg(pick(F.struct(*rest) if rest else F.lit(0), at).alias("_one"))
    return one.select(*(F.col(c) if c in keys else F.col(f"_one.{c}").alias(c) for c in df.columns))


def blank_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of a composite key as text, a missing one as blank, so that it counts like any other."""
    return df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})


def new_composite(current: DataFrame, previous: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of ``current`` whose composite key ``previous`` lacks; of repeated keys the last in ``order``. Blank parts count."""
    return keep_one(blank_keys(current, keys), keys, *order, last=True).join(blank_keys(previous, keys).select(keys).distinct(), keys, "left_anti")


def merged_passes(passes: list[DataFrame], keys: list[str], *order: Column) -> DataFrame:
    """One row for each told key of several passes, with the number of its ``pass``: of the first pass that has it, there the first in ``order``."""
    every = reduce(DataFrame.unionByName, [df.withColumn("pass", F.lit(i)) for i, df in enumerate(passes)])
    return keep_one(with_key(every, keys), keys, F.col("pass"), *order)


def last_rows(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each told key: of repeated ones the last in ``order``."""
    return keep_one(with_key(df, keys), keys, *order, last=True)


def with_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are neither null nor empty."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys]))


def _told(df: DataFrame, keys: list[str], order: Column | None) -> DataFrame:
    """Rows with a told key; where an order is given, the last of each key."""
    return with_key(df, keys) if order is None else last_rows(df, keys, order)


def new_rows(current: DataFrame, previous: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows of ``current`` whose key ``previous`` lacks; with ``order`` the last row of a repeated key alone."""
    return _told(current, keys, order).join(with_key(previous, keys).select(keys).distinct(), keys, "left_anti")


def retained_rows(current: DataFrame, previous: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows of ``current`` whose key ``previous`` has; with ``order`` the last row of a repeated key alone."""
    return _told(current, keys, order).join(with_key(previous, keys).select(keys).distinct(), keys, "left_semi")


def churned_rows(current: DataFrame, previous: DataFrame, keys: list[str], uninstalls: DataFrame | None = None, order: Column | None = None) -> DataFrame:
    """Keys of ``previous`` that are gone; with ``uninstalls`` only those the log confirms, so an empty log confirms none."""
    gone = new_rows(previous, current, keys, order)
    return gone if uninstalls is None else gone.join(uninstalls.select(keys).distinct(), keys, "left_semi")


def delta_counts(current: DataFrame, previous: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """current, previous, new, churned, retained distinct keys of each group of either side, and the churn rate."""
    marked = (
        with_key(current, keys).select(group, *keys, F.lit(1).alias("c"), F.lit(0).alias("p"))
        .unionByName(with_key(previous, keys).select(group, *keys, F.lit(0).alias("c"), F.lit(1).alias("p")))
        .groupBy(group, *keys).agg(F.max("c").alias("c"), F.max("p").alias("p"))
    )
    out = marked.groupBy(group).agg(
        F.sum("c").alias("current"), F.sum("p").alias("previous"), F.sum((F.col("c") > F.col("p")).cast("long")).alias("new"),
        F.sum((F.col("p") > F.col("c")).cast("long")).alias("churned"), F.sum(F.col("c") * F.col("p")).cast("long").alias("retained"),
    )
    return out.withColumn("churn_rate", F.coalesce(F.try_divide(F.col("churned").cast("double"), F.col("previous").cast("double")), F.lit(0.0)))


def with_total(counts: DataFrame, group: str, total: str = "all_apps") -> DataFrame:
    """``delta_counts`` and a row of their sums; the total rate is the ratio of sums."""
    names = ["current", "previous", "new", "churned", "retained"]
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).withColumn("churn_rate", F.coalesce(F.try_divide(F.col("churned").cast("double"), F.col("previous").cast("double")), F.lit(0.0)))
    out = counts.unionByName(sums.withColumn(group, F.lit(total)))
    return out.withColumn("net_growth", F.col("current") - F.col("previous"))


def kpi_rows(report: DataFrame, group: str, run_stamp: str, total: str = "all_apps") -> DataFrame:
    """Long KPI rows (run_stamp, group, metric_name, value); the total has a null group."""
    names = ["current", "previous", "new", "churned", "churn_rate", "net_growth"]
    long = report.select(group, *(F.col(c).cast("double").alias(c) for c in names)).unpivot([group], names, "metric_name", "value")
    return long.select(F.lit(run_stamp).alias("run_stamp"), F.nullif(F.col(group), F.lit(total)).alias(group), "metric_name", "value")


def uninstall_counts(current: DataFrame, previous: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """current, previous and new distinct composite keys of each group of either side; blank parts count."""
    a, b = (blank_keys(x, keys).select(group, *keys, F.lit(c).alias("c"), F.lit(1 - c).alias("p")) for x, c in ((current, 1), (previous, 0)))
    marked = a.unionByName(b).groupBy(group, *keys).agg(F.max("c").alias("c"), F.max("p").alias("p"))
    return marked.groupBy(group).agg(F.sum("c").alias("current"), F.sum("p").alias("previous"), F.sum((F.col("c") > F.col("p")).cast("long")).alias("new_uninstalls"))


def run_report(sellers: DataFrame, uninstalls: DataFrame, group: str, total: str = "all_apps") -> DataFrame:
    """``delta_counts`` and ``uninstall_counts`` side by side, apps of either, with the row of totals.

    Net growth is new less churned, and the total churn rate the ratio of sums.
    """
    s = sellers.select(group, "current", "previous", F.col("new").alias("new_installs"), F.col("churned").alias("churned_sellers"), F.col("retained").alias("retained_sellers"))
    names = ["current", "previous", "new_installs", "churned_sellers", "retained_sellers", "new_uninstalls"]
    # by grouping, so that a null group is one group of both sides
    both = s.unionByName(uninstalls.select(group, "new_uninstalls"), allowMissingColumns=True).groupBy(group).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names))
    sums = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).withColumn(group, F.lit(total))
    out = both.unionByName(sums)
    rate = F.coalesce(F.try_divide(F.col("churned_sellers").cast("double"), F.col("previous").cast("double")), F.lit(0.0))
    return out.withColumn("net_growth", F.col("new_installs") - F.col("churned_sellers")).withColumn("churn_rate", rate)


def metric_rows(report: DataFrame, platforms: DataFrame, group: str, run_stamp: str, total: str = "all_apps") -> DataFrame:
    """The metrics table (run_stamp, app_name, metric_name, value, delta_from_previous, meta) of ``run_report``.

    Seven rows an app, six for all of them with a null app_name. ``platforms`` (group, platform, n):
    ``platform_split`` is their number, and ``meta`` has the counts.
    """
    split = platforms.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", "n")))).alias("split"))
    r = report.join(split, group, "left")
    change, none, told = (F.col("current") - F.col("previous")).cast("double"), F.lit(None).cast("double"), F.col(group) != total
    row = lambda name, value, delta=none, meta=None: F.struct(F.lit(name).alias("metric_name"), value.cast("double").alias("value"), delta.alias("delta_from_previous"), (F.lit(None).cast("map<string,bigint>") if meta is None else meta).alias("meta"))
    own = [row("total_active", F.col("current"), change), *(row(c, F.col(c)) for c in ("new_installs", "churned_sellers", "retained_sellers", "churn_rate", "new_uninstalls"))]
    own.append(row("platform_split", F.coalesce(F.size("split"), F.lit(0)), none, F.coalesce("split", F.create_map().cast("map<string,bigint>"))))
    sums = [row("total_active", F.col("current"), change), *(row(c, F.col(c)) for c in ("new_installs", "churned_sellers", "new_uninstalls", "net_growth", "churn_rate"))]
    rows = F.explode(F.when(told, F.array(*own)).otherwise(F.array(*sums))).alias("m")
    return r.select(F.lit(run_stamp).alias("run_stamp"), F.when(told, F.col(group)).alias("app_name"), rows).select("run_stamp", "app_name", "m.*")


def lifecycle_events(current: DataFrame, previous: DataFrame, key: str, uninstalls: DataFrame | None = None, order: Column | None = None) -> DataFrame:
    """All events of the step from one snapshot to the next (columns plan, orders, failed).

    Keys are trimmed. Rows have one a key, or ``order`` tells which of a repeated key is the
    last, and that one counts. Events are those of ``change_events``, new_install with the plan after, and churned with plan and
    orders before; with ``uninstalls`` only keys that the log confirms have churned.
    """
    trimmed = lambda df: df.withColumn(key, F.trim(F.col(key).cast("string"))).where(F.col(key) != "")
    a, b = (_told(trimmed(df), [key], order) for df in (current, previous))
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    new = new_rows(a, b, [key]).select(key, F.lit("new_install").alias("kind"), none.alias("value_before"), none.alias("value_after"), text.alias("plan_before"), F.col("plan").alias("plan_after"))
    gone = churned_rows(a, b, [key], None if uninstalls is None else trimmed(uninstalls))
    gone = gone.select(key, F.lit("churned").alias("kind"), F.col("orders").alias("value_before"), none.alias("value_after"), F.col("plan").alias("plan_before"), text.alias("plan_after"))
    return change_events(a, b, [key]).unionByName(new).unionByName(gone)


def ordered_events(events: DataFrame, kinds: list[str], key: str, top: int = 40) -> DataFrame:
    """The first ``top`` events: kinds in the order given, others last, then the larger value after, then the key."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(kinds)), F.lit(len(kinds)))
    return events.withColumn("rank", rank).orderBy("rank", F.desc(F.coalesce("value_after", F.lit(0))), key, "kind").limit(top)


def new_uninstalls(current: DataFrame, previous: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row, the first in ``order``, of each told key of the log that the earlier log lacks."""
    return new_rows(keep_one(with_key(current, [key]), [key], *order), previous, [key])


def earliest_departures(df: DataFrame, on: Column, pos: str = "pos") -> DataFrame:
    """One row of each seller, that of the earliest day ``on``; of equal days the first row, rows without a day last.

    A row without a seller_id goes by its e-mail and user name.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.coalesce(F.nullif(F.col("seller_id").cast("string"), F.lit("")), F.concat(text("email"), F.lit("|"), text("username")))
    return keep_one(df.withColumn("_key", key), ["_key"], on.isNull(), on, F.col(pos)).drop("_key")


def coverage_alert(current: DataFrame, previous: DataFrame, uninstalls: DataFrame, key: str, most: int = 5, least: float = 0.85) -> DataFrame:
    """(before, now, ghosts, alert): keys gone without a trace; more than ``most``, or a snapshot below ``least`` of the one before."""
    ghosts = churned_rows(current, previous, [key]).join(uninstalls.select(key).distinct(), key, "left_anti")
    n = lambda df, name: with_key(df, [key]).agg(F.count_distinct(key).alias(name))
    one = n(previous, "before").crossJoin(n(current, "now")).crossJoin(n(ghosts, "ghosts"))  # one row each
    return one.withColumn("alert", (F.col("ghosts") > most) | ((F.col("now") < least * F.col("before")) & (F.col("now") > 0)))


def diff_rows(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Both sides of every key (installed and paying booleans, status, plan, mrr) and what changed.

    A key in ``previous`` alone has no change, as rows that vanish are no departures.
    """
    fields = ("installed", "status", "plan", "mrr")
    c = with_key(current, [key]).select(key, *(F.col(f).alias(f"{f}_now") for f in fields), F.lit(True).alias("is_now"))
    p = with_key(previous, [key]).select(key, *(F.col(f).alias(f"{f}_was") for f in fields), F.lit(True).alias("was"))
    both = c.join(p, key, "full_outer").na.fill(False, ["is_now", "was", "installed_now", "installed_was"]).na.fill(0.0, ["mrr_now", "mrr_was"])
    now, was, both_sides = F.coalesce(F.col("status_now"), F.lit("")) == "Purchased", F.coalesce(F.col("status_was"), F.lit("")) == "Purchased", F.col("is_now") & F.col("was")
    plan = [F.trim(F.coalesce(F.col(f"plan_{x}"), F.lit(""))) for x in ("now", "was")]
    return both.select(
        "*", (F.col("is_now") & F.col("installed_now") & now).alias("paid_now"), (F.col("was") & F.col("installed_was") & was).alias("paid_was"),
        (F.col("is_now") & F.col("installed_now") & ~F.col("installed_was")).alias("new_install"), (both_sides & F.col("installed_was") & ~F.col("installed_now")).alias("new_uninstall"),
        F.when(F.col("was"), F.col("is_now") & now & ~was).otherwise(F.col("is_now") & now & F.col("installed_now")).alias("new_payer"),
        (both_sides & was & ~now).alias("newly_churned"), (both_sides & was & now & (plan[0] != "") & (plan[1] != "") & (plan[0] != plan[1])).alias("plan_changed"),
        F.round(F.col("mrr_now") - F.col("mrr_was"), 2).alias("delta"),
    )


def diff_summary(rows: DataFrame) -> DataFrame:
    """The thirteen figures of ``diff_rows``, in one row."""
    money = lambda c, when: F.round(F.coalesce(F.sum(F.when(F.col(when), F.col(c).cast("decimal(18,2)"))).cast("double"), F.lit(0.0)), 2)
    out = rows.agg(
        F.count_if("is_now").alias("current_total"), F.count_if("was").alias("previous_total"), F.count_if("paid_now").alias("current_paid"), F.count_if("paid_was").alias("previous_paid"),
        money("mrr_now", "paid_now").alias("mrr_now"), money("mrr_was", "paid_was").alias("mrr_prev"), F.count_if("new_install").alias("new_installs"), F.count_if("new_uninstall").alias("new_uninstalls"),
        F.count_if("new_payer").alias("new_payers"), F.count_if("newly_churned").alias("newly_churned"),
        F.count_if(F.col("plan_changed") & (F.col("delta") > 0)).alias("plan_upgrades"), F.count_if(F.col("plan_changed") & (F.col("delta") < 0)).alias("plan_downgrades"),
    )
    return out.withColumn("mrr_delta", F.round(F.col("mrr_now") - F.col("mrr_prev"), 2))


def diff_lists(rows: DataFrame, key: str, top: int = 50) -> DataFrame:
    """(list, rank, key, amount): the ``top`` of each list, larger amounts first, then the key.

    Each list is a top-k of its own, so no list is sorted in one task.
    """
    lists = {"new_payers": ("new_payer", F.col("mrr_now")), "newly_churned": ("newly_churned", F.col("mrr_was")), "plan_changes": ("plan_changed", F.abs("delta")), "newly_uninstalled": ("new_uninstall", F.col("mrr_was"))}
    parts = [rows.where(flag).select(F.lit(name).alias("list"), key, amount.alias("amount")).orderBy(F.desc("amount"), key).limit(top) for name, (flag, amount) in lists.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("amount"), key)))


def change_events(current: DataFrame, previous: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """One row for each event of a key in both snapshots (columns plan, orders, failed).

    With ``order`` the last row of a repeated key counts, else keys are unique. A key may have several: a plan change between two told plans, a jump of orders, a
    rise of failed orders. The snapshots are joined once.
    """
    if order is not None:
        current, previous = last_rows(current, keys, order), last_rows(previous, keys, order)
    a = previous.select(*keys, F.col("plan").alias("plan_before"), F.col("orders").alias("o0"), F.col("failed").alias("f0"))
    both = current.select(*keys, F.col("plan").alias("plan_after"), F.col("orders").alias("o1"), F.col("failed").alias("f1")).join(a, keys)
    told = lambda c: ~F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("", "n/a", "—", "-")
    before, after = is_paid(F.col("plan_before")), is_paid(F.col("plan_after"))
    kind = F.when(~before & after, "plan_upgrade").when(before & ~after, "plan_downgrade").otherwise("plan_change")
    rise, least, share = F.col("o1") - F.col("o0"), *ORDER_SPIKE
    none = F.lit(None).cast("bigint")
    event = lambda k, x, y: F.struct(k.alias("kind"), x.alias("value_before"), y.alias("value_after"))
    events = F.array_compact(F.array(
        F.when((F.col("plan_before") != F.col("plan_after")) & told("plan_before") & told("plan_after"), event(kind, none, none)),
        F.when((rise >= least) & ((F.col("o0") == 0) | (rise >= share * F.greatest("o0", F.lit(1)))), event(F.lit("order_spike"), F.col("o0"), F.col("o1"))),
        F.when(F.col("f1") - F.col("f0") >= FAILED_SPIKE, event(F.lit("failed_order_spike"), F.col("f0"), F.col("f1"))),
    ))
    return both.select(*keys, "plan_before", "plan_after", F.explode(events).alias("e")).select(*keys, "e.*", "plan_before", "plan_after")


def fallback_join(df: DataFrame, lookup: DataFrame, keys: list[tuple[str, str]], take: list[str], order: Column) -> DataFrame:
    """Left join by the first key pair (left, right) that hits; of equal keys the last in ``order`` counts.

    Each key is an equi-join of its own with a lookup that has one row a key, so there is
    no join condition with OR, and rows of ``df`` stay one each. Blank keys hit nothing.
    """
    out = df
    for i, (left, right) in enumerate(keys):
        side = keep_one(lookup.where(F.col(right).isNotNull() & (F.col(right) != "")), [right], order, last=True)
        side = side.select(F.col(right).alias(f"_k{i}"), F.struct(*take).alias(f"_hit{i}"))
        out = out.join(side, F.col(left) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    hit = F.coalesce(*(F.col(f"_hit{i}") for i in range(len(keys))))
    return out.withColumn("_hit", hit).select(*df.columns, *(F.col(f"_hit.{c}").alias(f"matched_{c}") for c in take))


def any_key_semi(df: DataFrame, other: DataFrame, keys: list[tuple[str, str]], distinct_by: str) -> DataFrame:
    """Rows for which one of the key pairs is in ``other``: a union of semi-joins, distinct by a column."""
    parts = [df.join(other.where(F.col(right).isNotNull() & (F.col(right) != "")).select(F.col(right).alias("_k")).distinct(), F.col(left) == F.col("_k"), "left_semi") for left, right in keys]
    return reduce(DataFrame.unionByName, parts).dropDuplicates([distinct_by])


def snapshot_diff(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Status of each key (columns plan, mrr): added, removed, plan_changed or same, with the change of mrr."""
    c = current.select(key, F.col("plan").alias("plan_after"), F.col("mrr").alias("m1"), F.lit(True).alias("is_now"))
    p = previous.select(key, F.col("plan").alias("plan_before"), F.col("mrr").alias("m0"), F.lit(True).alias("was"))
    both = c.join(p, key, "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(F.col("plan_after") != F.col("plan_before"), "plan_changed").otherwise("same")
    return both.select(key, status.alias("status"), "plan_before", "plan_after", (F.coalesce("m1", F.lit(0.0)) - F.coalesce("m0", F.lit(0.0))).alias("mrr_delta"))
