"""More registered queries: run reports, gates, lifecycle events, normalised rows, leads, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, scores, text
from tidemark.operators import gates, leads, revenue, rows, segments, series, snapshots, store
from tidemark.plans import queries as base
from tidemark.plans.queries import _ACC, _CLASS, _DEP, _HEALTH, _PROD, _SNAPS, _SUB, query
from tidemark.sources.tables import AS_OF, accounts, departures, table, with_products

_STAMP = "1999-07-01_00-00-00Z"
#: The departure log before and after a day, as two runs saw it; some parts of its keys are not told.
_CUT = "2024-01-15"
_LOGS = f"{_DEP}, log AS (SELECT pos, app, CASE WHEN pos % 11 <> 0 THEN CAST(seller_id AS VARCHAR) ELSE '' END AS seller_id, CASE WHEN pos % 7 <> 0 THEN platform ELSE '' END AS platform, strftime(left_on, '%Y-%m-%d') AS day, left_on FROM dep)"


def _logs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = departures(spark, sf).select(
        "pos", "app", F.when(F.col("pos") % 11 != 0, F.col("seller_id").cast("string")).alias("seller_id"), F.when(F.col("pos") % 7 != 0, F.col("platform")).alias("platform"),
        F.date_format("left_on", "yyyy-MM-dd").alias("day"), "left_on",
    )
    return d, d.where(F.col("left_on") < F.lit(_CUT).cast("timestamp_ntz"))


_KEYS = ["seller_id", "platform", "day"]


@query(f"WITH {_LOGS} SELECT seller_id, platform, day, max(pos) AS pos FROM log l WHERE NOT EXISTS (SELECT 1 FROM log p WHERE p.left_on < TIMESTAMP '{_CUT}' AND p.seller_id = l.seller_id AND p.platform = l.platform AND p.day = l.day) GROUP BY 1, 2, 3")
def uninstall_delta(spark, sf):
    """New entries of the log by seller, platform and day; blank parts count, the last of repeated rows stays."""
    now, before = _logs(spark, sf)
    return snapshots.new_composite(now, before, _KEYS, F.col("pos")).select(*_KEYS, "pos")


_UNINSTALLS = f"""u AS (SELECT app, count(*) AS "current", count(*) FILTER (WHERE was) AS previous, count(*) FILTER (WHERE NOT was) AS new_uninstalls FROM (SELECT app, seller_id, platform, day, bool_or(left_on < TIMESTAMP '{_CUT}') AS was FROM log GROUP BY 1, 2, 3, 4) GROUP BY 1)"""


@query(f"WITH {_LOGS}, {_UNINSTALLS} SELECT * FROM u")
def uninstall_counts(spark, sf):
    return snapshots.uninstall_counts(*_logs(spark, sf), "app", _KEYS)


_REPORT = base._COUNTS + f""", {_LOGS}, {_UNINSTALLS}, b AS (SELECT coalesce(g.app, u.app) AS app, coalesce(g."current", 0) AS "current", coalesce(g.previous, 0) AS previous, coalesce(new, 0) AS new_installs, coalesce(churned, 0) AS churned_sellers, coalesce(retained, 0) AS retained_sellers, coalesce(new_uninstalls, 0) AS new_uninstalls FROM g FULL JOIN u ON g.app = u.app),
 t AS (SELECT * FROM b UNION ALL SELECT 'all_apps', sum("current")::BIGINT, sum(previous)::BIGINT, sum(new_installs)::BIGINT, sum(churned_sellers)::BIGINT, sum(retained_sellers)::BIGINT, sum(new_uninstalls)::BIGINT FROM b),
 report AS (SELECT *, new_installs - churned_sellers AS net_growth, coalesce(churned_sellers::DOUBLE / nullif(previous, 0), 0.0) AS churn_rate FROM t)"""


def _report(spark, sf):
    counts = snapshots.delta_counts(*base._pair(spark, sf), "app", ["seller_id"])
    return snapshots.run_report(counts, uninstall_counts(spark, sf), "app")


@query(_REPORT + " SELECT * FROM report")
def run_report(spark, sf):
    return _report(spark, sf)


@query(_REPORT + f""", sp AS (SELECT app, CASE WHEN plan = '' THEN 'unknown' ELSE plan END AS platform, count(*) AS n FROM cur GROUP BY 1, 2), k AS (SELECT app, count(*) AS n, string_agg(platform || '=' || n, ',' ORDER BY platform) AS split FROM sp GROUP BY 1),
 long AS (SELECT app AS a, 'total_active' AS metric_name, "current"::DOUBLE AS value, ("current" - previous)::DOUBLE AS delta_from_previous, NULL AS split FROM report UNION ALL SELECT app, 'new_installs', new_installs, NULL, NULL FROM report UNION ALL SELECT app, 'churned_sellers', churned_sellers, NULL, NULL FROM report
 UNION ALL SELECT app, 'churn_rate', churn_rate, NULL, NULL FROM report UNION ALL SELECT app, 'new_uninstalls', new_uninstalls, NULL, NULL FROM report UNION ALL SELECT app, 'retained_sellers', retained_sellers, NULL, NULL FROM report WHERE app <> 'all_apps'
 UNION ALL SELECT app, 'net_growth', net_growth, NULL, NULL FROM report WHERE app = 'all_apps' UNION ALL SELECT report.app, 'platform_split', coalesce(k.n, 0), NULL, coalesce(split, '') FROM report LEFT JOIN k ON k.app = report.app WHERE report.app <> 'all_apps')
 SELECT '{_STAMP}' AS run_stamp, nullif(a, 'all_apps') AS app_name, metric_name, value, delta_from_previous, split FROM long""")
def metric_rows(spark, sf):
    cur, _ = base._pair(spark, sf)
    platforms = cur.groupBy("app", text.platform_slug(F.col("plan")).alias("platform")).agg(F.count("*").alias("n"))
    m = snapshots.metric_rows(_report(spark, sf), platforms, "app", _STAMP)
    entries = F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.withColumn("split", F.when(F.col("meta").isNotNull(), F.array_join(entries, ","))).drop("meta")


_LIFE = base._EVENTS + f""", d AS (SELECT DISTINCT user_id AS seller_id FROM events WHERE event_type = 'error'),
 life AS (SELECT CAST(seller_id AS VARCHAR) AS seller_id, kind, value_before, value_after, plan_before, plan_after FROM ev UNION ALL SELECT CAST(seller_id AS VARCHAR), 'new_install', NULL, NULL, NULL, plan FROM cur ANTI JOIN prev USING (seller_id)
 UNION ALL SELECT CAST(seller_id AS VARCHAR), 'churned', orders, NULL, plan, NULL FROM prev ANTI JOIN cur USING (seller_id) SEMI JOIN d USING (seller_id))"""


def _life(spark, sf):
    return snapshots.lifecycle_events(*base._pair(spark, sf), "seller_id", departures(spark, sf).select("seller_id"))


@query(_LIFE + " SELECT * FROM life")
def lifecycle_events(spark, sf):
    return _life(spark, sf)


_KINDS = ("churned", "plan_downgrade", "failed_order_spike", "plan_upgrade", "order_spike", "new_install")


@query(_LIFE + f" SELECT seller_id, kind, value_after FROM life ORDER BY coalesce(list_position({list(_KINDS)}, kind), 99), coalesce(value_after, 0) DESC, seller_id, kind LIMIT 40")
def event_feed(spark, sf):
    return snapshots.ordered_events(_life(spark, sf), list(_KINDS), "seller_id").select("seller_id", "kind", "value_after")


@query(f"WITH {_LOGS} SELECT l.seller_id, min(l.pos) AS pos FROM log l WHERE l.seller_id <> '' AND l.seller_id NOT IN (SELECT seller_id FROM log WHERE left_on < TIMESTAMP '{_CUT}') GROUP BY 1")
def new_uninstalls(spark, sf):
    return snapshots.new_uninstalls(*_logs(spark, sf), "seller_id", F.col("pos")).select("seller_id", "pos")


@query(f"WITH {_SNAPS}, n AS (SELECT (SELECT count(*) FROM prev) AS before, (SELECT count(*) FROM cur) AS now, (SELECT count(*) FROM prev ANTI JOIN cur USING (seller_id) WHERE seller_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')) AS ghosts) SELECT *, ghosts > 5 OR (now < 0.85 * before AND now > 0) AS alert FROM n")
def coverage_alert(spark, sf):
    return snapshots.coverage_alert(*base._pair(spark, sf), departures(spark, sf).select("seller_id"), "seller_id")


# two snapshots of subscriptions: installed by the number of orders, paying by plan
_BOTH = f"""{_SNAPS}, c AS (SELECT seller_id, orders % 6 <> 0 AS installed, CASE WHEN plan IN ('Premium', 'Lite') THEN 'Purchased' WHEN plan = 'Free' THEN '' ELSE 'License Expired' END AS status, plan, spend AS mrr FROM cur),
 p AS (SELECT seller_id, orders % 5 <> 0 AS installed, CASE WHEN plan IN ('Premium', 'Lite') THEN 'Purchased' WHEN plan = 'Free' THEN '' ELSE 'License Expired' END AS status, plan, spend AS mrr FROM prev),
 j AS (SELECT coalesce(c.seller_id, p.seller_id) AS seller_id, c.seller_id IS NOT NULL AS is_now, p.seller_id IS NOT NULL AS was, coalesce(c.installed, false) AS i1, coalesce(p.installed, false) AS i0, coalesce(c.status, '') AS s1, coalesce(p.status, '') AS s0, coalesce(c.plan, '') AS p1, coalesce(p.plan, '') AS p0, coalesce(c.mrr, 0) AS m1, coalesce(p.mrr, 0) AS m0 FROM c FULL JOIN p ON c.seller_id = p.seller_id),
 f AS (SELECT *, i1 AND s1 = 'Purchased' AS paid1, i0 AND s0 = 'Purchased' AS paid0, is_now AND i1 AND NOT i0 AS new_install, is_now AND was AND i0 AND NOT i1 AS new_uninstall, CASE WHEN was THEN is_now AND s1 = 'Purchased' AND s0 <> 'Purchased' ELSE s1 = 'Purchased' AND i1 END AS new_payer,
 is_now AND was AND s0 = 'Purchased' AND s1 <> 'Purchased' AS newly_churned, is_now AND was AND s0 = 'Purchased' AND s1 = 'Purchased' AND p0 <> p1 AS plan_changed, round(m1 - m0, 2) AS delta FROM j)"""


def _diff(spark, sf):
    paid = F.when(F.col("plan").isin("Premium", "Lite"), "Purchased").when(F.col("plan") != "Free", "License Expired")
    c, p = (d.select("seller_id", (F.col("orders") % k != 0).alias("installed"), paid.alias("status"), "plan", F.col("spend").alias("mrr")) for d, k in zip(base._pair(spark, sf), (6, 5), strict=True))
    return snapshots.diff_rows(c, p, "seller_id")


@query(f"""WITH {_BOTH} SELECT count(*) FILTER (WHERE is_now) AS current_total, count(*) FILTER (WHERE was) AS previous_total, count(*) FILTER (WHERE paid1) AS current_paid, count(*) FILTER (WHERE paid0) AS previous_paid, coalesce(round(sum(CASE WHEN paid1 THEN CAST(m1 AS DECIMAL(18,2)) END)::DOUBLE, 2), 0.0) AS mrr_now,
 coalesce(round(sum(CASE WHEN paid0 THEN CAST(m0 AS DECIMAL(18,2)) END)::DOUBLE, 2), 0.0) AS mrr_prev, count(*) FILTER (WHERE new_install) AS new_installs, count(*) FILTER (WHERE new_uninstall) AS new_uninstalls, count(*) FILTER (WHERE new_payer) AS new_payers, count(*) FILTER (WHERE newly_churned) AS newly_churned,
 count(*) FILTER (WHERE plan_changed AND delta > 0) AS plan_upgrades, count(*) FILTER (WHERE plan_changed AND delta < 0) AS plan_downgrades, round(mrr_now - mrr_prev, 2) AS mrr_delta FROM f""")
def diff_summary(spark, sf):
    return snapshots.diff_summary(_diff(spark, sf))


@query(f"""WITH {_BOTH}, l AS (SELECT 'new_payers' AS list, seller_id, m1 AS amount FROM f WHERE new_payer UNION ALL SELECT 'newly_churned', seller_id, m0 FROM f WHERE newly_churned UNION ALL SELECT 'plan_changes', seller_id, abs(delta) FROM f WHERE plan_changed UNION ALL SELECT 'newly_uninstalled', seller_id, m0 FROM f WHERE new_uninstall)
 SELECT list, seller_id, amount, CAST(row_number() OVER (PARTITION BY list ORDER BY amount DESC, seller_id) AS INT) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY list ORDER BY amount DESC, seller_id) <= 50""")
def diff_lists(spark, sf):
    return snapshots.diff_lists(_diff(spark, sf), "seller_id")


# pages of event types: traces in which some users' pages repeat, jump, are empty or fall short
_TRACE = """tr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id FROM events), trace AS (SELECT user_id, pos, CASE WHEN user_id % 5 = 1 AND pos = 2 THEN 1 ELSE pos END AS page_num, CASE WHEN user_id % 5 = 2 AND pos <= 2 THEN -1 ELSE event_id END AS first_key,
 CASE WHEN user_id % 5 = 3 AND pos = 1 THEN 0 ELSE 10 END AS rows, CASE WHEN user_id % 5 = 4 THEN pos * 11 ELSE pos * 10 END AS reported FROM tr),
 pg AS (SELECT user_id, count(*) FILTER (WHERE page_num <> pos) AS out_of_order, count(*) - count(DISTINCT first_key) AS repeated, count(*) FILTER (WHERE rows = 0) - CASE WHEN arg_max(rows, pos) = 0 THEN 1 ELSE 0 END AS empty_inside, abs(sum(rows) - max(reported))::DOUBLE / max(reported) AS off FROM trace GROUP BY 1),
 pages_checked AS (SELECT user_id, out_of_order, repeated, empty_inside, off, CASE WHEN out_of_order > 0 OR repeated > 0 OR empty_inside > 0 OR off > 0.05 THEN 'blocked' ELSE 'ok' END AS status FROM pg)"""


def _trace(spark, sf):
    u, pos = F.col("user_id") % 5, F.col("pos")
    t = table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("pos"))
    return t.select(
        "user_id", "pos", F.when((u == 1) & (pos == 2), 1).otherwise(pos).alias("page_num"), F.when((u == 2) & (pos <= 2), -1).otherwise(F.col("event_id")).alias("first_key"),
        F.when((u == 3) & (pos == 1), 0).otherwise(10).alias("rows"), F.when(u == 4, pos * 11).otherwise(pos * 10).alias("reported"),
    )


@query(f"WITH {_TRACE} SELECT * FROM pages_checked")
def pagination_check(spark, sf):
    return gates.pagination_check(_trace(spark, sf), "user_id")


# labels of a grid: platforms an app's departures name, of which some are required, some known
_GRID = f"""{_DEP}, seen AS (SELECT DISTINCT app, CASE WHEN platform = 'p0' THEN 'p0' ELSE platform END AS name FROM dep WHERE NOT (app = 'app1' AND platform = 'p2')), known AS (SELECT app, name, name = 'p2' AS required FROM (SELECT DISTINCT app FROM dep) CROSS JOIN (SELECT unnest(['p0', 'p1', 'p2']) AS name) WHERE NOT (app = 'app2' AND name = 'p1')),
 grid AS (SELECT app, coalesce(list_sort(list(name) FILTER (WHERE NOT s AND required)), []) AS missing, coalesce(list_sort(list(name) FILTER (WHERE required IS NULL)), []) AS unexpected FROM (SELECT coalesce(seen.app, known.app) AS app, coalesce(seen.name, known.name) AS name, seen.name IS NOT NULL AS s, required FROM seen FULL JOIN known ON seen.app = known.app AND seen.name = known.name) GROUP BY 1),
 grids AS (SELECT app, array_to_string(missing, ',') AS missing, array_to_string(unexpected, ',') AS unexpected, CASE WHEN len(missing) > 0 THEN 'blocked' WHEN len(unexpected) > 0 THEN 'pending_review' ELSE 'ok' END AS status FROM grid)"""


def _grid(spark, sf):
    d = departures(spark, sf).where("not (app = 'app1' and platform = 'p2')")
    observed = d.select("app", F.when(F.col("platform") == "p0", F.lit(" P0 ")).otherwise(F.col("platform")).alias("label")).distinct()
    labels = spark.createDataFrame([("p0", False), ("p1", False), ("p2", True)], "label string, required boolean")
    expected = departures(spark, sf).select("app").distinct().crossJoin(F.broadcast(labels)).where("not (app = 'app2' and label = 'p1')")
    return gates.grid_check(observed, expected, "app")


@query(f"WITH {_GRID} SELECT * FROM grids")
def grid_check(spark, sf):
    g = _grid(spark, sf)
    return g.select("app", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), "status")


# row counts by app and kind: sellers of two quarters, and the log of two thirds of a month
_KINDROWS = f"""{_SNAPS}, {_DEP}, now_rows AS (SELECT app, 'sellers' AS kind, seller_id FROM cur WHERE seller_id % CASE app WHEN 'BUILDING' THEN 4 WHEN 'MACHINERY' THEN 2 ELSE 1 END = 0 UNION ALL SELECT app, 'uninstalls', pos FROM dep WHERE left_on >= TIMESTAMP '{_CUT}'),
 was_rows AS (SELECT app, 'sellers' AS kind, seller_id FROM prev UNION ALL SELECT app, 'uninstalls', pos FROM dep WHERE left_on < TIMESTAMP '{_CUT}' AND app <> 'app0'),
 counted AS (SELECT app, kind, coalesce(a.n, 0) AS rows, coalesce(b.n, 0) AS before FROM (SELECT app, kind, count(*) AS n FROM now_rows GROUP BY 1, 2) a FULL JOIN (SELECT app, kind, count(*) AS n FROM was_rows GROUP BY 1, 2) b USING (app, kind)),
 dropped AS (SELECT *, CASE WHEN before > 0 THEN greatest(0.0::DOUBLE, (before - rows)::DOUBLE / before) END AS "drop" FROM counted), rowcheck AS (SELECT *, CASE WHEN "drop" > 0.5 THEN 'blocked' WHEN "drop" > 0.2 THEN 'pending_review' ELSE 'ok' END AS status FROM dropped)"""


def _kind_rows(spark, sf):
    (cur, prev), d = base._pair(spark, sf), departures(spark, sf)
    few = F.when(F.col("app") == "BUILDING", 4).when(F.col("app") == "MACHINERY", 2).otherwise(1)
    late = F.col("left_on") >= F.lit(_CUT).cast("timestamp_ntz")
    kind = lambda df, name, key: df.select("app", F.lit(name).alias("kind"), F.col(key).alias("seller_id"))
    now = kind(cur.where(F.col("seller_id") % few == 0), "sellers", "seller_id").unionByName(kind(d.where(late), "uninstalls", "pos"))
    return now, kind(prev, "sellers", "seller_id").unionByName(kind(d.where(~late & (F.col("app") != "app0")), "uninstalls", "pos"))


@query(f"WITH {_KINDROWS} SELECT * FROM rowcheck")
def row_drop_check(spark, sf):
    return gates.row_drop_check(*_kind_rows(spark, sf), ["app", "kind"])


_VERDICT = f"""{_KINDROWS}, {_GRID.replace(_DEP + ', ', '')}, checks AS (SELECT app, kind, 'row_count' AS c, status FROM rowcheck UNION ALL SELECT app, 'uninstalls', 'grid', status FROM grids),
 verdict AS (SELECT app, kind, CASE max(CASE status WHEN 'blocked' THEN 2 WHEN 'pending_review' THEN 1 ELSE 0 END) WHEN 2 THEN 'blocked' WHEN 1 THEN 'pending_review' ELSE 'ok' END AS status, coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE status <> 'ok'), '') AS failed FROM checks GROUP BY 1, 2)"""


def _verdicts(spark, sf):
    grid = _grid(spark, sf).withColumn("kind", F.lit("uninstalls"))
    return gates.verdicts({"row_count": gates.row_drop_check(*_kind_rows(spark, sf), ["app", "kind"]), "grid": grid}, ["app", "kind"])


@query(f"WITH {_VERDICT} SELECT * FROM verdict")
def run_verdicts(spark, sf):
    return _verdicts(spark, sf).withColumn("failed", F.array_join("failed", ","))


@query(f"""WITH {_VERDICT}, ok AS (SELECT * FROM now_rows n WHERE NOT EXISTS (SELECT 1 FROM verdict v WHERE v.app = n.app AND v.kind = n.kind AND v.status = 'blocked'))
 SELECT app, kind, seller_id, false AS staged FROM ok UNION ALL SELECT app, kind, seller_id, false FROM was_rows w WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.app = w.app AND ok.kind = w.kind)
 UNION ALL SELECT app, kind, seller_id, true FROM now_rows n WHERE EXISTS (SELECT 1 FROM verdict v WHERE v.app = n.app AND v.kind = n.kind AND v.status = 'blocked')""")
def promotion(spark, sf):
    latest, staged = gates.promoted(*_kind_rows(spark, sf), _verdicts(spark, sf), ["app", "kind"])
    return latest.withColumn("staged", F.lit(False)).unionByName(staged.withColumn("staged", F.lit(True)))


@query(_REPORT + " SELECT bool_or(app = 'all_apps' AND previous = 0 AND \"current\" > 0 AND new_installs = \"current\" AND churned_sellers = 0) AS stale, coalesce(string_agg(app, ',' ORDER BY app) FILTER (WHERE app <> 'all_apps' AND previous = 0 AND \"current\" > 0), '') AS empty_apps FROM report")
def stale_diff(spark, sf):
    return gates.stale_diff(_report(spark, sf), "app").withColumn("empty_apps", F.array_join("empty_apps", ","))


_RAW = """raw AS (SELECT c_custkey AS seller_id, CASE c_custkey % 4 WHEN 0 THEN ' HTTPS://WWW.' || c_name || '.Com/Shop/ ' WHEN 1 THEN lower(c_name) || '.com' WHEN 2 THEN 'demo-' || lower(c_name) || '.com/' END AS store_url, CASE WHEN c_custkey % 5 <> 0 THEN ' ' || upper(c_name) || CASE c_custkey % 3 WHEN 0 THEN '@Acme.test ' WHEN 1 THEN '@mail.acme.test' ELSE '@x.com' END END AS email,
 '  ' || c_mktsegment || '  plan ' AS plan, CASE c_custkey % 4 WHEN 0 THEN '03/04/2026' WHEN 1 THEN '2026-04-18 10:11:12' WHEN 2 THEN 'soon' END AS installed_on, c_custkey * 7 % 900 AS n FROM customer)"""


def _raw(spark, sf):
    k, low = F.col("c_custkey"), F.lower("c_name")
    return table(spark, sf, "customer").select(
        k.alias("seller_id"), F.when(k % 4 == 0, F.concat(F.lit(" HTTPS://WWW."), "c_name", F.lit(".Com/Shop/ "))).when(k % 4 == 1, F.concat(low, F.lit(".com"))).when(k % 4 == 2, F.concat(F.lit("demo-"), low, F.lit(".com/"))).alias("store_url"),
        F.when(k % 5 != 0, F.concat(F.lit(" "), F.upper("c_name"), F.when(k % 3 == 0, "@Acme.test ").when(k % 3 == 1, "@mail.acme.test").otherwise("@x.com"))).alias("email"),
        F.concat(F.lit("  "), "c_mktsegment", F.lit("  plan ")).alias("plan"), F.when(k % 4 == 0, "03/04/2026").when(k % 4 == 1, "2026-04-18 10:11:12").when(k % 4 == 2, "soon").alias("installed_on"), (k * 7 % 900).alias("n"),
    )


_NORMAL = f"""{_RAW}, norm AS (SELECT seller_id, CASE seller_id % 4 WHEN 0 THEN lower(trim(replace(store_url, ' HTTPS://WWW.', ''))[:-11]) || '.com/Shop' WHEN 1 THEN store_url WHEN 2 THEN store_url[:-2] ELSE '' END AS store_url, coalesce(lower(trim(email)), '') AS email, trim(regexp_replace(plan, '\\s+', ' ', 'g')) AS plan,
 CASE seller_id % 4 WHEN 0 THEN '2026-04-03' WHEN 1 THEN '2026-04-18' WHEN 2 THEN 'soon' END AS installed_on, n FROM raw)"""


@query(f"WITH {_NORMAL} SELECT * FROM norm")
def normalized_sellers(spark, sf):
    return rows.normalize_sellers(_raw(spark, sf))


@query(f"WITH {_NORMAL} SELECT seller_id FROM norm WHERE NOT (email IN ('customer#000000002@x.com') OR regexp_matches(email, '@([^@]*\\.)?acme\\.test$') OR store_url LIKE 'demo-%')")
def internal_rows_excluded(spark, sf):
    n = rows.normalize_sellers(_raw(spark, sf))
    return rows.exclude_internal(n, ("customer#000000002@x.com",), ("acme.test",)).select("seller_id")


_TEXTED = f"""{_ACC}, texted AS (SELECT seller_id, plan, CASE seller_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' ELSE CAST(orders AS VARCHAR) END AS order_count, CASE WHEN seller_id % 3 = 0 THEN '1,' || lpad(CAST(orders AS VARCHAR), 3, '0') WHEN seller_id % 3 = 1 THEN '' END AS product_count, CAST(failed AS VARCHAR) || '.0' AS failed_order_count, strftime(installed_d, '%d/%m/%Y') AS installed_on, installed_d, orders, failed FROM acc),
 nums AS (SELECT *, CASE WHEN seller_id % 5 < 2 THEN 0 ELSE orders END AS o, CASE WHEN seller_id % 3 = 0 THEN 1000 + orders ELSE 0 END AS p, CAST(DATE '{AS_OF}' - installed_d AS INT) AS days FROM texted)"""
_FITN = f"""CAST(greatest(0, least(100, round_even(CASE WHEN {base._IS_PAID} THEN 30.0::DOUBLE + least(50.0::DOUBLE, o / 10.0::DOUBLE) + least(20.0::DOUBLE, p / 50.0::DOUBLE) - CASE WHEN failed::DOUBLE / nullif(o, 0) > 0.1 THEN 15.0 ELSE 0.0 END ELSE least(35.0::DOUBLE, days / 4.3::DOUBLE) + least(30.0::DOUBLE, p / 20.0::DOUBLE) + least(30.0::DOUBLE, o * 2.0::DOUBLE) END, 0))) AS INT)"""


@query(f"WITH {_TEXTED}, s AS (SELECT *, {_FITN} AS score FROM nums) SELECT seller_id, {base._IS_PAID} AS paid, o AS order_count, p AS product_count, failed AS failed_order_count, days AS days_since_install, score AS fit_score, CASE WHEN score >= 75 THEN 'Hot' WHEN score >= 50 THEN 'Warm' WHEN score >= 25 THEN 'Cool' ELSE 'Low' END AS temperature FROM s")
def insight(spark, sf):
    """Fit of accounts whose counts are text, some of it missing or no number."""
    k, o = F.col("seller_id"), F.col("orders").cast("string")
    a = accounts(spark, sf).select(
        "seller_id", "plan", F.when(k % 5 == 1, "N/A").when(k % 5 > 1, o).alias("order_count"), F.when(k % 3 == 0, F.concat(F.lit("1,"), F.lpad(o, 3, "0"))).when(k % 3 == 1, "").alias("product_count"),
        F.concat(F.col("failed").cast("string"), F.lit(".0")).alias("failed_order_count"), F.date_format("installed_d", "dd/MM/yyyy").alias("installed_on"), F.lit(None).cast("string").alias("steps_completed"),
    )
    return rows.with_insight(a, AS_OF).select("seller_id", *(f"insight.{c}" for c in ("paid", "order_count", "product_count", "failed_order_count", "days_since_install", "fit_score", "temperature")))


@query(f"""WITH {_ACC}, x AS (SELECT seller_id, CASE WHEN seller_id % 3 > 0 THEN orders END AS o, CASE WHEN seller_id % 4 > 0 THEN failed END AS f, CASE WHEN seller_id % 5 > 0 THEN orders % 5 END AS h FROM acc)
 SELECT seller_id, CAST(round_even(least(40.0::DOUBLE, 8 * ln(1 + coalesce(o, 0))) + least(30.0::DOUBLE, 5 * ln(1 + coalesce(f, 0))), 0) AS INT) AS opportunity, CAST(round_even(least(35.0::DOUBLE, 7.0 * coalesce(h, 0)) + least(35.0::DOUBLE, 6 * ln(1 + coalesce(o, 0))), 0) AS INT) AS winback,
 CAST(least(100, round_even(5 + 30.0::DOUBLE * (1 - least(coalesce(f, 0)::DOUBLE / 10, 1.0)) + 5 + 10, 0)) AS INT) AS health FROM x""")
def scores_of_unknown_counts(spark, sf):
    k, none = F.col("seller_id"), F.lit(None).cast("int")
    o, f, h = F.when(k % 3 > 0, F.col("orders")), F.when(k % 4 > 0, F.col("failed")), F.when(k % 5 > 0, F.col("orders") % 5)
    return accounts(spark, sf).select(
        "seller_id", scores.opportunity_score(o, f, none, none).alias("opportunity"), scores.winback_score(F.lit(True), h, o, none).alias("winback"), scores.health_score(none, f.cast("double") / 10, F.lit(False), none).alias("health")
    )


_NAMES = ("9 Months $90", "Standard 9 month", "1 Year Subscription Plan", "Half-Yearly", "Pro $1,200 Yearly", "n/a", "6 Months Subscription Plan $ 90.60")
_TOLD = (("9 Month", 9, 90.0, 10.0), ("Standard", 9, None, 0.0), ("Yearly", 12, None, 12.5), ("Half-Yearly", 12, None, 0.0), ("Pro", 12, 1200.0, 100.0), ("", 0, None, 0.0), ("Half-Yearly", 6, 90.6, 15.1))


@query("SELECT c_custkey, label, m AS period_months, price AS price_usd, monthly AS monthly_usd FROM customer JOIN (VALUES " + ", ".join(
    f"({i}, '{a}', {b}, {'NULL' if c is None else c}::DOUBLE, {d}::DOUBLE)" for i, (a, b, c, d) in enumerate((t if n != "Half-Yearly" else ("Yearly", *t[1:])) for n, t in zip(_NAMES, _TOLD, strict=True))) + ") v(i, label, m, price, monthly) ON c_custkey % 7 = i")
def plan_periods(spark, sf):
    """Plans of all periods; half-yearly holds yearly, which is tried first."""
    plan = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", scores.parse_plan(plan, {"1 year subscription plan": 12.5}).alias("p")).select("c_custkey", "p.*")


@query(base._series_sql("month").split(" spine AS")[0].rstrip().rstrip(",") + f""", {_DEP}, d0 AS (SELECT app, date_trunc('month', left_on)::DATE AS start, count(DISTINCT seller_id) AS u FROM dep GROUP BY 1, 2), c2 AS (SELECT app, start, sum(n)::BIGINT AS n, sum(u)::BIGINT AS u FROM (SELECT app, start, n, 0 AS u FROM c UNION ALL SELECT app, start, 0, u FROM d0) GROUP BY 1, 2),
 spine AS (SELECT unnest(generate_series((SELECT min(start) FROM c2)::TIMESTAMP, (SELECT max(start) FROM c2)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS start), dn AS (SELECT app, start, coalesce(n, 0) AS n, coalesce(u, 0) AS u FROM (SELECT DISTINCT app FROM c2) CROSS JOIN spine LEFT JOIN c2 USING (app, start))
 SELECT app, strftime(start, '%Y-%m') AS period, n AS installs, u AS uninstalls FROM dn UNION ALL SELECT 'all_apps', strftime(start, '%Y-%m'), sum(n)::BIGINT, sum(u)::BIGINT FROM dn GROUP BY start""")
def install_uninstall_series(spark, sf):
    return series.two_series(accounts(spark, sf), departures(spark, sf), "app", "installed_d", "left_on", "seller_id", "month")


@query(f"WITH {_ACC}, x AS (SELECT app, CASE WHEN seller_id % 6 > 0 THEN strftime(installed_d, '%Y-%m') END AS month, CASE WHEN seller_id % 5 > 0 THEN steps ELSE '(not set)' END AS label FROM acc), y AS (SELECT * FROM x UNION ALL SELECT 'all_apps', month, label FROM x) SELECT app, (100.0 * count(*) FILTER (WHERE month IS NOT NULL AND label <> '(not set)') / count(*))::DOUBLE AS coverage_pct FROM y GROUP BY 1")
def steps_coverage(spark, sf):
    a = accounts(spark, sf).select("app", F.when(F.col("seller_id") % 6 > 0, F.col("installed_d")).alias("d"), F.when(F.col("seller_id") % 5 > 0, F.col("steps")).alias("steps"))
    return series.steps_by_month(a, "app", "d", "steps")[1]


@query(f"WITH {_ACC}, {_DEP}, s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-13', TIMESTAMP '2024-01-20', INTERVAL 1 DAY))::DATE AS day) SELECT day, (SELECT count(*) FROM acc WHERE installed_d + 8000 = day) AS installs, (SELECT count(*) FROM dep WHERE CAST(left_on AS DATE) = day) AS uninstalls FROM s")
def daily_timeline(spark, sf):
    a = accounts(spark, sf).withColumn("shown_d", F.date_add("installed_d", 8000))
    return series.daily_timeline(a, departures(spark, sf), "shown_d", "left_on", "2024-01-20")


@query(f"WITH {_ACC}, {_PROD}, r AS (SELECT app, count(*) FILTER (WHERE products = 0) AS zero, count(*) FILTER (WHERE products > 0) AS active, sum(products)::BIGINT AS products, count(*) AS total FROM prod GROUP BY 1) SELECT * FROM r UNION ALL SELECT 'all_apps', sum(zero)::BIGINT, sum(active)::BIGINT, sum(products)::BIGINT, sum(total)::BIGINT FROM r")
def product_activity(spark, sf):
    return segments.product_activity(with_products(spark, sf, accounts(spark, sf)), "app")


@query(f"WITH {_ACC}, k AS (SELECT app, {_CLASS} AS k FROM acc), r AS (SELECT app, count(*) FILTER (WHERE k = 'Paid') AS paid, count(*) FILTER (WHERE k = 'Free') AS free, count(*) FILTER (WHERE k = 'Not Paid') AS not_paid, count(*) AS total FROM k GROUP BY 1) SELECT * FROM r UNION ALL SELECT 'all_apps', sum(paid)::BIGINT, sum(free)::BIGINT, sum(not_paid)::BIGINT, sum(total)::BIGINT FROM r")
def paid_totals(spark, sf):
    return segments.with_sums(base.paid_breakdown(spark, sf), "app")


@query(f"""WITH {_ACC}, {_PROD}, b AS (SELECT app, {_CLASS} AS plan_class, orders, products FROM prod), e AS (SELECT * FROM b UNION ALL SELECT 'all_apps', plan_class, orders, products FROM b), g AS (SELECT * FROM e UNION ALL SELECT app, 'all', orders, products FROM e)
 SELECT app, plan_class, count(*) FILTER (WHERE orders > 0) AS active, count(*) FILTER (WHERE orders = 0) AS zero, count(*) AS total, sum(orders)::BIGINT AS orders, sum(products)::BIGINT AS products FROM g GROUP BY 1, 2""")
def activity_by_class(spark, sf):
    return segments.activity_by_class(with_products(spark, sf, accounts(spark, sf)), "app", scores.plan_class(F.col("plan")))


@query(f"WITH {_ACC}, p AS (SELECT app, plan FROM acc WHERE plan NOT IN ('', 'N/A')), t AS (SELECT plan FROM p GROUP BY 1 ORDER BY count(*) DESC, plan LIMIT 3), q AS (SELECT app, plan, count(*) AS n FROM p SEMI JOIN t USING (plan) GROUP BY 1, 2) SELECT * FROM q UNION ALL SELECT 'all_apps', plan, sum(n)::BIGINT FROM q GROUP BY 2")
def plan_top_by_app(spark, sf):
    return segments.top_by_group(accounts(spark, sf).where(~F.col("plan").isin("", "N/A")), "app", "plan", 3)


@query(f"WITH {_ACC}, r AS (SELECT seller_id, CAST(spend AS DECIMAL(18,2)) AS v FROM acc WHERE spend > 0), k AS (SELECT *, row_number() OVER (ORDER BY v DESC, seller_id) AS rank FROM r) SELECT CAST(rank AS INT) AS rank, seller_id, CAST(v AS DOUBLE) AS spend, round(CAST(v AS DOUBLE) / (SELECT CAST(sum(v) AS DOUBLE) FROM r), 4) AS share FROM k WHERE rank <= 50")
def top_payers(spark, sf):
    return revenue.top_payers(accounts(spark, sf), "seller_id", "spend")


@query(f"WITH {_SUB} SELECT count(*) FILTER (WHERE installed AND paying AND days_to_expiration - 40 BETWEEN 0 AND 90) AS sellers, coalesce(sum(CASE WHEN installed AND paying AND days_to_expiration - 40 BETWEEN 0 AND 90 THEN CAST(mrr AS DECIMAL(18,2)) END)::DOUBLE, 0.0) AS mrr, count(*) FILTER (WHERE installed AND paying AND days_to_expiration - 40 < 0) AS expired FROM sub")
def renewal_totals(spark, sf):
    return revenue.renewal_totals(base.subscriptions(spark, sf).withColumn("days_to_expiration", F.col("days_to_expiration") - 40))


@query(f"WITH {_SUB}, h AS (SELECT {_HEALTH} AS health, mrr FROM sub WHERE installed AND paying), b AS (SELECT greatest(0, CAST(ceil(health / 10.0) AS INT) - 1) AS band, count(*) AS sellers, sum(mrr) AS mrr FROM h GROUP BY 1) SELECT CAST(i AS INT) AS band, CASE WHEN i = 0 THEN 0 ELSE i * 10 + 1 END || '-' || (i * 10 + 10) AS name, coalesce(sellers, 0) AS sellers, coalesce(mrr, 0.0)::DOUBLE AS mrr FROM range(10) r(i) LEFT JOIN b ON band = i")
def health_bands(spark, sf):
    return revenue.dense_score_bands(base._healthy(spark, sf).where("installed and paying"), "health")


@query(f"WITH {_ACC}, {_PROD}, f AS (SELECT {base._FIT} AS score FROM prod), t AS (SELECT CASE WHEN score >= 75 THEN 'Hot' WHEN score >= 50 THEN 'Warm' WHEN score >= 25 THEN 'Cool' ELSE 'Low' END AS tier FROM f) SELECT n AS tier, count(t.tier) AS n FROM (SELECT unnest(['Hot', 'Warm', 'Cool', 'Low']) AS n) LEFT JOIN t ON t.tier = n GROUP BY 1")
def temperature_counts(spark, sf):
    return leads.temperature_counts(base._fit(spark, sf).withColumn("t", scores.temperature(F.col("score"))), "t")


_LISTS = base.ORACLE_SQL["lead_rules"]


def _ruled(spark, sf):
    a = base._fit(spark, sf).withColumn("steps", F.col("orders") % 5)
    return a.join(segments.lead_rules(a), "seller_id")


for _rule, _by in leads.ORDERS.items():
    _col = {"days": f"CAST(DATE '{AS_OF}' - installed_d AS INT)"}.get(_by, _by)
    base.ORACLE_SQL[f"leads_{_rule}"] = f"WITH l AS ({_LISTS}), {_ACC}, {_PROD} SELECT seller_id, {_col} AS amount FROM prod JOIN l USING (seller_id) WHERE rule = '{_rule}' ORDER BY amount DESC, seller_id LIMIT 50"
    base.QUERIES[f"leads_{_rule}"] = lambda spark, sf, rule=_rule, by=_by: leads.ordered_list(_ruled(spark, sf), rule, "seller_id", 50).select("seller_id", F.col(by).alias("amount"))


@query(f"WITH {_SUB} SELECT seller_id, round(mrr * (100 - {_HEALTH}), 1) AS risk FROM sub WHERE installed AND paying AND mrr > 0 ORDER BY risk DESC, seller_id LIMIT 25")
def risk_top(spark, sf):
    return leads.risk_list(base._healthy(spark, sf), "seller_id").select("seller_id", "risk")


@query(f"WITH b AS ({base.ORACLE_SQL['lead_bucket']}), t AS (SELECT CASE WHEN bucket IN ('renewal_at_risk', 'trial_conversion', 'upgrade_ready', 'winback_high_value') THEN 'Hot' WHEN bucket IN ('cross_sell_oldapps', 'paid_idle', 'failure_spike') THEN 'Warm' WHEN bucket IS NOT NULL THEN 'Cool' END AS tier FROM b) SELECT n AS tier, count(tier) AS n FROM (SELECT unnest(['Hot', 'Warm', 'Cool']) AS n) LEFT JOIN t ON tier = n GROUP BY 1")
def bucket_tiers(spark, sf):
    return leads.bucket_tiers(base.lead_bucket(spark, sf))


def _leads(spark, sf):
    s = base._healthy(spark, sf).join(base.lead_bucket(spark, sf), "seller_id")
    age = F.datediff(F.lit(AS_OF).cast("date"), "installed_d")
    return s.withColumns({
        "skus": F.lit(0), "history": F.col("orders") % 5, "other_apps": F.col("orders") % 3, "age_days": age, "onboarding": F.when(F.col("orders") % 5 == 4, "COMPLETE").otherwise("STARTED"),
        "opportunity": scores.opportunity_score(F.col("orders"), F.lit(0), age, F.col("idle_days")), "winback": scores.winback_score(~F.col("installed") & F.col("paying"), F.col("orders") % 5, F.col("orders"), F.col("idle_days")),
    })


_LEADS = f"""WITH b AS ({base.ORACLE_SQL['lead_bucket']}), w AS ({base.ORACLE_SQL['winback_score']}), {_SUB}, s AS (SELECT sub.*, bucket, w.score AS winback, {_HEALTH} AS health, {base._DAYS} AS age FROM sub JOIN b USING (seller_id) JOIN w USING (seller_id)),
 o AS (SELECT *, CAST(round_even(least(40.0::DOUBLE, 8 * ln(1 + orders)) + CASE WHEN age BETWEEN 30 AND 365 THEN 15 WHEN age >= 7 THEN 8 ELSE 0 END + CASE WHEN idle_days BETWEEN 1 AND 14 THEN 15 ELSE 0 END, 0) AS INT) AS opportunity FROM s)"""


@query(_LEADS + """, r AS (SELECT bucket, seller_id, CASE bucket WHEN 'renewal_at_risk' THEN mrr * 1000 + (30 - greatest(0, coalesce(nullif(days_to_expiration, 0), 999))) * 10 WHEN 'trial_conversion' THEN orders WHEN 'upgrade_ready' THEN opportunity WHEN 'winback_high_value' THEN winback WHEN 'paid_idle' THEN mrr * 100 + idle_days
 WHEN 'failure_spike' THEN failure_rate * coalesce(nullif(orders, 0), 1) ELSE orders END::DOUBLE AS amount FROM o WHERE bucket IS NOT NULL) SELECT * FROM r""")
def lead_order(spark, sf):
    """What rows are ordered by within their bucket."""
    d = _leads(spark, sf).where("bucket is not null")
    return d.select("bucket", "seller_id", leads.lead_rank({c: F.col(c) for c in ("bucket", "orders", "skus", "mrr", "days_to_expiration", "idle_days", "failure_rate", "opportunity", "winback")}).alias("amount"))


@query(_LEADS + """ SELECT bucket, seller_id, country, orders, 0 AS skus, CASE WHEN bucket IN ('renewal_at_risk', 'paid_idle', 'failure_spike') THEN round(mrr, 2) END AS mrr, CASE WHEN bucket IN ('renewal_at_risk', 'paid_idle', 'failure_spike') THEN left(plan, 35) WHEN bucket IN ('upgrade_ready', 'trial_conversion', 'cross_sell_oldapps') THEN left(plan, 30) END AS plan,
 CASE WHEN bucket IN ('renewal_at_risk', 'paid_idle', 'failure_spike') THEN health END AS health, CASE WHEN bucket = 'renewal_at_risk' THEN days_to_expiration END AS days_to_expiry, CASE WHEN bucket = 'paid_idle' THEN idle_days END AS days_since_login, CASE WHEN bucket = 'failure_spike' THEN round(100 * failure_rate, 1) END AS failure_pct,
 CASE WHEN bucket IN ('upgrade_ready', 'trial_conversion', 'cross_sell_oldapps') THEN opportunity END AS opportunity, CASE WHEN bucket = 'winback_high_value' THEN winback END AS winback, CASE WHEN bucket = 'winback_high_value' THEN orders % 5 END AS plan_history, CASE WHEN bucket = 'cross_sell_oldapps' THEN orders % 3 END AS other_apps,
 CASE WHEN bucket = 'stuck_onboarding' THEN CASE WHEN orders % 5 = 4 THEN 'COMPLETE' ELSE 'STARTED' END END AS onboarding, CASE WHEN bucket = 'stuck_onboarding' THEN age END AS days_since_install FROM o WHERE bucket IS NOT NULL""")
def lead_summary(spark, sf):
    return leads.lead_summary(_leads(spark, sf).where("bucket is not null"))


@query("SELECT coalesce(nullif(o_orderpriority, ''), '(not set)') AS status, count(*) AS n FROM orders GROUP BY 1")
def purchase_status_counts(spark, sf):
    return leads.status_counts(table(spark, sf, "orders"), "o_orderpriority")


_TWO = base.ORACLE_SQL["install_uninstall_series"]


@query(f"SELECT app, sum(installs)::BIGINT AS installs, sum(uninstalls)::BIGINT AS uninstalls FROM ({_TWO}) WHERE period LIKE '2024%' GROUP BY 1")
def focus_year(spark, sf):
    return leads.focus_period(install_uninstall_series(spark, sf), year=2024)


@query(f"SELECT app, installs, uninstalls FROM ({_TWO}) QUALIFY period = max(period) OVER ()")
def focus_latest(spark, sf):
    return leads.focus_period(install_uninstall_series(spark, sf))


@query(f"SELECT app, period, 100 * ((installs - i)::DOUBLE / nullif(i, 0)) AS installs_growth_pct FROM (SELECT *, lag(installs) OVER (PARTITION BY app ORDER BY period) AS i FROM ({_TWO})) WHERE left(period, 4) IN ('1997', '1996')")
def growth_shown(spark, sf):
    g = series.growth_of(install_uninstall_series(spark, sf), "app", "installs", "uninstalls")
    return leads.visible_growth(g, 1997).select("app", "period", "installs_growth_pct")


@query(f"WITH {_ACC}, {_DEP} SELECT d.seller_id, left_on, coalesce(orders, 0) AS orders FROM (SELECT seller_id, min(left_on) AS left_on FROM dep WHERE CAST(left_on AS DATE) BETWEEN DATE '2024-01-13' AND DATE '2024-01-20' GROUP BY 1) d LEFT JOIN acc USING (seller_id)")
def seven_day_departures(spark, sf):
    return leads.recent_departures(departures(spark, sf), accounts(spark, sf), "seller_id", "2024-01-13", "2024-01-20")


@query("WITH s AS (SELECT c_custkey AS seller_id, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS manually_edited_at FROM customer), e AS (SELECT user_id AS seller_id, max(ts) AS t FROM events GROUP BY 1) SELECT seller_id, greatest(manually_edited_at, t) AS manually_edited_at FROM s LEFT JOIN e USING (seller_id)")
def locked_by_edits(spark, sf):
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("seller_id"), F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-10").cast("timestamp_ntz")).alias("manually_edited_at"))
    return store.locked_by_edits(stored, table(spark, sf, "events").select(F.col("user_id").alias("seller_id"), F.col("ts").alias("edited_at")), ["seller_id"])


@query(f"""WITH {_SNAPS}, o AS (SELECT seller_id, plan, orders AS order_count, CASE WHEN seller_id % 10 = 0 THEN TIMESTAMP '1999-05-01' END AS e FROM prev), n AS (SELECT seller_id, plan, CASE WHEN seller_id % 4 > 0 THEN orders END AS order_count FROM cur)
 SELECT coalesce(o.seller_id, n.seller_id) AS seller_id, CASE WHEN n.seller_id IS NOT NULL AND e IS NULL THEN n.plan ELSE o.plan END AS plan, CASE WHEN n.seller_id IS NOT NULL AND e IS NULL THEN n.order_count ELSE o.order_count END AS order_count, e AS manually_edited_at,
 CASE WHEN o.seller_id IS NULL THEN TIMESTAMP '1999-07-01' ELSE TIMESTAMP '1999-04-01' END AS first_seen_at, CASE WHEN n.seller_id IS NULL THEN TIMESTAMP '1999-04-01' ELSE TIMESTAMP '1999-07-01' END AS last_scraped_at,
 CASE WHEN n.seller_id IS NULL THEN 'kept' WHEN o.seller_id IS NULL THEN 'insert' WHEN e IS NULL THEN 'update' ELSE 'locked' END AS change FROM o FULL JOIN n ON o.seller_id = n.seller_id""")
def account_upsert(spark, sf):
    cur, prev = base._pair(spark, sf)
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    stored = prev.select("seller_id", "plan", F.col("orders").alias("order_count"), F.when(F.col("seller_id") % 10 == 0, at("1999-05-01")).alias("manually_edited_at"), at("1999-04-01").alias("first_seen_at"), at("1999-04-01").alias("last_scraped_at"))
    count = F.when(F.col("seller_id") % 4 == 1, F.concat(F.lit(" "), F.col("orders").cast("string"))).when(F.col("seller_id") % 4 > 1, F.col("orders").cast("string")).otherwise("N/A")
    return store.upsert_accounts(stored, cur.select("seller_id", "plan", count.alias("order_count"), at("1999-07-01").alias("scraped_at")), ["seller_id"], ["plan", "order_count"], ("order_count",))


@query("""WITH s AS (SELECT user_id, min(ts) AS started_at, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS page, 'old' AS user_agent FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), b AS (SELECT user_id, min(ts) AS f, max(ts) AS l, arg_max(event_type, ts) AS page, arg_max(CASE WHEN event_id % 3 = 0 THEN 'new' END, CASE WHEN event_id % 3 = 0 THEN ts END) AS agent FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
 SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(b.page, s.page) AS page, coalesce(agent, user_agent) AS user_agent, coalesce(started_at, f) AS started_at, coalesce(l, last_seen) AS last_seen FROM s FULL JOIN b ON s.user_id = b.user_id""")
def session_merge(spark, sf):
    e, cut = table(spark, sf, "events"), F.lit("2024-01-10").cast("timestamp_ntz")
    old = e.where(F.col("ts") < cut).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("page"), F.lit("old").alias("user_agent"), F.min("ts").alias("started_at"), F.max("ts").alias("last_seen"))
    beats = e.where(F.col("ts") >= cut).select("user_id", F.col("event_type").alias("page"), F.when(F.col("event_id") % 3 == 0, "new").alias("user_agent"), F.col("ts").alias("at"))
    return store.merge_sessions(old, beats, "user_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-05')")
def profiles_to_make(spark, sf):
    cache = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("cached_at"))
    return store.profiles_to_make(table(spark, sf, "customer").select("c_custkey"), cache, ["c_custkey"], "2024-02-04")


@query(f"WITH {_DEP}, x AS (SELECT pos, CASE WHEN pos % 4 = 0 THEN 'none' ELSE 'Shop ' || platform || ' ' || strftime(left_on, '%Y-%m-%d %H:%M:%S') || '  web/x ' || strftime(left_on, '%Y-%m-%d %H:%M:%S') END AS raw, strftime(left_on, '%Y-%m-%d %H:%M:%S') AS t, platform FROM dep) SELECT pos, 0 AS shop_pos, CASE WHEN pos % 4 = 0 THEN '' ELSE 'Shop ' || platform END AS platform, CASE WHEN pos % 4 = 0 THEN '' ELSE t END AS uninstalled_on FROM x UNION ALL SELECT pos, 1, 'web/x', t FROM x WHERE pos % 4 <> 0")
def shops_exploded(spark, sf):
    t = F.date_format("left_on", "yyyy-MM-dd HH:mm:ss")
    raw = F.when(F.col("pos") % 4 == 0, "none").otherwise(F.concat(F.lit("Shop "), "platform", F.lit(" "), t, F.lit("  web/x "), t))
    return rows.explode_shops(departures(spark, sf).select("pos", raw.alias("shops_raw"))).drop("shops_raw")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN url ELSE 'https://' || regexp_extract(url, '^https?://([^/]*)', 1) END AS url FROM pages")
def fetchable_urls(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    raw = F.when(F.col("page_id") % 3 == 0, "shops.example").when(F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("//"), host))
    return table(spark, sf, "pages").select("page_id", text.fetchable_url(raw, ("shops.example",)).alias("url"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%SZ') AS stamp, date_trunc('second', ts) AS parsed, ltrim(strftime(ts, '%d %b %Y'), '0') AS day, 'Q' || quarter(ts) || '/' || strftime(ts, '%y') AS short FROM events")
def run_stamps(spark, sf):
    stamp = dates.run_stamp(F.col("ts"))
    return table(spark, sf, "events").select("event_id", stamp.alias("stamp"), dates.parse_run_stamp(stamp).alias("parsed"), dates.day_label(F.date_format("ts", "yyyy-MM-dd")).alias("day"), dates.short_period_label(dates.period_key(F.col("ts"), "quarter"), "quarter").alias("short"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY 1")
def sessions_by_console(spark, sf):
    """Users active since a day, by the kind of their events."""
    e = table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz"))
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' AND user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 100")
def recent_activity(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error' and user_id % 2 = 0")
    return e.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "ts")


@query("SELECT DISTINCT CAST(year(d) AS INT) AS year FROM (SELECT o_orderdate AS d FROM orders UNION ALL SELECT ts FROM events)")
def distinct_years(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderdate").alias("d")).unionByName(table(spark, sf, "events").select(F.col("ts").alias("d")))
    return rows.years_of(a, "d")


@query(f"WITH {_SUB}, x AS (SELECT {_HEALTH} AS health FROM sub) SELECT count(*) FILTER (WHERE health >= 50) AS success, count(*) FILTER (WHERE health < 25) AS failure, count(*) FILTER (WHERE health >= 25 AND health < 50) AS running FROM x")
def run_outcomes(spark, sf):
    h = base._healthy(spark, sf)
    outcome = F.when(F.col("health") >= 50, "success").when(F.col("health") < 25, "failure").otherwise("running")
    return h.agg(*(F.count_if(outcome == x).alias(x) for x in ("success", "failure", "running")))


@query(f"WITH {_SUB} SELECT count(*) FILTER (WHERE installed) AS installed, count(*) FILTER (WHERE installed AND {_CLASS} = 'Paid') AS purchased, count(*) FILTER (WHERE installed AND plan = 'Free') AS free, count(*) FILTER (WHERE installed AND plan = 'Free Trial') AS trial, (SELECT count(*) FROM events WHERE event_type = 'error') AS lifetime_uninstalls, round(100.0::DOUBLE * count(*) FILTER (WHERE installed AND {_CLASS} = 'Paid') / nullif(count(*) FILTER (WHERE installed), 0), 1) AS paid_pct FROM sub")
def headline(spark, sf):
    plan = F.lower(F.trim("plan"))
    here = lambda c: F.count_if(F.col("installed") & c)
    one = base.subscriptions(spark, sf).agg(F.count_if("installed").alias("installed"), here(scores.plan_class(F.col("plan")) == "Paid").alias("purchased"), here(plan == "free").alias("free"), here(plan == "free trial").alias("trial"))
    gone = departures(spark, sf).agg(F.count("*").alias("lifetime_uninstalls"))
    return one.crossJoin(gone).withColumn("paid_pct", F.round(F.try_divide(100.0 * F.col("purchased"), F.col("installed").cast("double")), 1))


@query(_LIFE + " SELECT kind, count(*) AS n FROM life GROUP BY 1")
def lifecycle_event_summary(spark, sf):
    return _life(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN length(source) > 8 THEN left(source, 8) || '…' ELSE source END AS source, CASE WHEN length(target) > 8 THEN left(target, 8) || '…' ELSE target END AS target, n FROM (" + base.ORACLE_SQL["plan_flow"] + ")")
def plan_flow_shown(spark, sf):
    return revenue.shown_flows(base.plan_flow(spark, sf), 8)


@query("SELECT app, period, n FROM (" + base.ORACLE_SQL["monthly_series"] + ") WHERE period BETWEEN '1996-04' AND '1997-03'")
def clipped_series(spark, sf):
    return series.clip_periods(base.QUERIES["monthly_series"](spark, sf), "1997-03")


@query(base.ORACLE_SQL["monthly_series"])
def unclipped_series(spark, sf):
    """A month that the series lacks clips nothing."""
    return series.clip_periods(base.QUERIES["monthly_series"](spark, sf), "2031-01")


@query(f"WITH {_DEP}, x AS (SELECT pos, CASE WHEN pos % 3 > 0 THEN CAST(seller_id AS VARCHAR) ELSE 'u' || (pos % 50) || '|' END AS k, CASE WHEN pos % 4 > 0 THEN CAST(left_on AS DATE) END AS d FROM dep) SELECT k, arg_min(pos, (d IS NULL, d, pos)) AS pos FROM x GROUP BY 1")
def earliest_departures(spark, sf):
    k = F.col("pos") % 3 > 0
    d = departures(spark, sf).select("pos", F.when(k, F.col("seller_id").cast("string")).otherwise("").alias("seller_id"), F.concat(F.lit("u"), F.col("pos") % 50).alias("email"), F.lit(None).cast("string").alias("username"), F.when(F.col("pos") % 4 > 0, F.to_date("left_on")).alias("d"))
    out = snapshots.earliest_departures(d, F.col("d"))
    return out.select(F.when(F.col("seller_id") != "", F.col("seller_id")).otherwise(F.concat("email", F.lit("|"))).alias("k"), "pos")


@query("SELECT CASE WHEN title <> '' THEN 'TITLE: ' || title || chr(10) ELSE '' END || CASE WHEN description <> '' THEN 'DESC: ' || description || chr(10) ELSE '' END || 'BODY: ' || left(body, 60) AS prompt, page_id FROM (" + base.ORACLE_SQL["html_text"] + ")")
def page_prompts(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_prompt(F.col("html"), 60).alias("prompt"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS processed, count(*) FILTER (WHERE event_type = 'signup') AS hits, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def enrichment_stats(spark, sf):
    source = F.when(F.col("event_type") == "purchase", "model").when(F.col("event_type") == "signup", "cache").otherwise(F.col("event_type"))
    return store.enrichment_stats(table(spark, sf, "events").select(source.alias("source")))
