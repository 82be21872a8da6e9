"""Registered queries over the synthetic tables, each beside SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scores, text
from tidemark.functions.dates import period_label
from tidemark.operators import revenue, segments, series, snapshots, store
from tidemark.sources.tables import AS_OF, accounts, departures, snapshot, table, with_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PREVIOUS, CURRENT = ("1999-01-01", "1999-04-01"), ("1999-04-01", "1999-07-01")

_PLAN = "CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 1500 THEN 'N/A' WHEN c_acctbal < 3000 THEN 'Free' WHEN c_acctbal < 4500 THEN 'Free Trial' WHEN c_acctbal < 6500 THEN 'Lite $30 Monthly' WHEN c_acctbal < 8500 THEN 'Standard $1,200 Yearly' ELSE 'Premium' END"
_ACC = f"""acc AS (SELECT c_mktsegment AS app, c_custkey AS seller_id, n_name AS country, {_PLAN} AS plan, installed_d, last_d, orders, failed, spend, (orders % 5) || '/4' AS steps
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS installed_d, CAST(max(o_orderdate) AS DATE) AS last_d, count(*) AS orders,
 count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
_PROD = "prod AS (SELECT acc.*, coalesce(products, 0) AS products FROM acc LEFT JOIN (SELECT o_custkey, count(DISTINCT l_partkey) AS products FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) x ON seller_id = o_custkey)"
_CLASS = "CASE WHEN plan IN ('', 'N/A') THEN 'Not Paid' WHEN plan IN ('Free', 'Free Trial') THEN 'Free' ELSE 'Paid' END"
_IS_PAID = "plan NOT IN ('', 'N/A', 'Free')"


def _snap(name: str, days: tuple[str, str]) -> str:
    return f"""{name} AS (SELECT c_mktsegment AS app, o_custkey AS seller_id, CASE left(pr, 1) WHEN '1' THEN 'Premium' WHEN '2' THEN 'Lite' WHEN '3' THEN 'Free' WHEN '4' THEN 'N/A' ELSE 'Trial' END AS plan, orders, failed, spend
 FROM (SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS pr, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend
 FROM orders WHERE o_orderdate >= TIMESTAMP '{days[0]}' AND o_orderdate < TIMESTAMP '{days[1]}' GROUP BY 1) JOIN customer ON c_custkey = o_custkey)"""


_SNAPS = _snap("cur", CURRENT) + ", " + _snap("prev", PREVIOUS)
_DEP = "dep AS (SELECT event_id AS pos, 'app' || (user_id % 3) AS app, user_id AS seller_id, 'p' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS platform, ts AS left_on FROM events WHERE event_type = 'error')"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return snapshot(spark, sf, *CURRENT), snapshot(spark, sf, *PREVIOUS)


_COUNTS = f"""WITH {_SNAPS}, m AS (SELECT coalesce(c.app, p.app) AS app, c.seller_id AS c, p.seller_id AS p FROM cur c FULL JOIN prev p ON c.app = p.app AND c.seller_id = p.seller_id),
 g AS (SELECT app, count(c) AS "current", count(p) AS previous, count(*) FILTER (WHERE p IS NULL) AS new, count(*) FILTER (WHERE c IS NULL) AS churned, count(*) FILTER (WHERE c IS NOT NULL AND p IS NOT NULL) AS retained FROM m GROUP BY 1)"""


@query(_COUNTS + """ SELECT *, coalesce(churned::DOUBLE / nullif(previous, 0), 0.0) AS churn_rate FROM g""")
def delta_counts(spark, sf):
    return snapshots.delta_counts(*_pair(spark, sf), "app", ["seller_id"])


_TOTAL = _COUNTS + """, t AS (SELECT * FROM g UNION ALL SELECT 'all_apps', sum("current")::BIGINT, sum(previous)::BIGINT, sum(new)::BIGINT, sum(churned)::BIGINT, sum(retained)::BIGINT FROM g),
 r AS (SELECT *, coalesce(churned::DOUBLE / nullif(previous, 0), 0.0) AS churn_rate, "current" - previous AS net_growth FROM t)"""


@query(_TOTAL + " SELECT * FROM r")
def churn_rate_report(spark, sf):
    return snapshots.with_total(snapshots.delta_counts(*_pair(spark, sf), "app", ["seller_id"]), "app")


@query(_TOTAL + """, u AS (UNPIVOT (SELECT app, "current"::DOUBLE AS "current", previous::DOUBLE AS previous, new::DOUBLE AS new, churned::DOUBLE AS churned, churn_rate, net_growth::DOUBLE AS net_growth FROM r) ON "current", previous, new, churned, churn_rate, net_growth INTO NAME metric_name VALUE value)
 SELECT '1999-07-01_00-00-00Z' AS run_stamp, nullif(app, 'all_apps') AS app, metric_name, value FROM u""")
def kpi_rows(spark, sf):
    return snapshots.kpi_rows(churn_rate_report(spark, sf), "app", "1999-07-01_00-00-00Z")


@query(f"WITH {_SNAPS} SELECT * FROM cur ANTI JOIN prev USING (seller_id)")
def delta_new(spark, sf):
    return snapshots.new_rows(*_pair(spark, sf), ["seller_id"])


@query(f"WITH {_SNAPS} SELECT * FROM prev ANTI JOIN cur USING (seller_id)")
def delta_churned(spark, sf):
    return snapshots.churned_rows(*_pair(spark, sf), ["seller_id"])


@query(f"WITH {_SNAPS} SELECT * FROM cur SEMI JOIN prev USING (seller_id)")
def delta_retained(spark, sf):
    return snapshots.retained_rows(*_pair(spark, sf), ["seller_id"])


@query(f"WITH {_SNAPS}, {_DEP} SELECT * FROM prev ANTI JOIN cur USING (seller_id) SEMI JOIN dep USING (seller_id)")
def gated_churn(spark, sf):
    return snapshots.churned_rows(*_pair(spark, sf), ["seller_id"], departures(spark, sf))


@query(f"WITH {_DEP} SELECT DISTINCT seller_id, platform, CAST(left_on AS DATE) AS day FROM dep d WHERE left_on >= TIMESTAMP '2024-01-15' AND NOT EXISTS (SELECT 1 FROM dep p WHERE p.left_on < TIMESTAMP '2024-01-15' AND p.seller_id = d.seller_id AND p.platform = d.platform)")
def composite_key_delta(spark, sf):
    d = departures(spark, sf)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    late, early = d.where(F.col("left_on") >= cut), d.where(F.col("left_on") < cut)
    return snapshots.new_rows(late, early, ["seller_id", "platform"]).select("seller_id", "platform", F.to_date("left_on").alias("day")).distinct()


_EVENTS = f"""WITH {_SNAPS}, j AS (SELECT c.app, seller_id, p.plan AS plan_before, c.plan AS plan_after, p.orders AS o0, c.orders AS o1, p.failed AS f0, c.failed AS f1 FROM cur c JOIN prev p USING (seller_id)),
 ev AS (SELECT seller_id, CASE WHEN plan_before IN ('Free', 'Trial') AND plan_after IN ('Premium', 'Lite') THEN 'plan_upgrade' WHEN plan_after IN ('Free', 'Trial') AND plan_before IN ('Premium', 'Lite') THEN 'plan_downgrade' ELSE 'plan_change' END AS kind, NULL::BIGINT AS value_before, NULL::BIGINT AS value_after, plan_before, plan_after FROM j WHERE plan_before <> plan_after AND plan_before <> 'N/A' AND plan_after <> 'N/A'
 UNION ALL SELECT seller_id, 'order_spike', o0, o1, plan_before, plan_after FROM j WHERE o1 - o0 >= 5 AND (o0 = 0 OR (o1 - o0) >= 0.5 * o0)
 UNION ALL SELECT seller_id, 'failed_order_spike', f0, f1, plan_before, plan_after FROM j WHERE f1 - f0 >= 3)"""


@query(_EVENTS + " SELECT * FROM ev")
def change_events(spark, sf):
    return snapshots.change_events(*_pair(spark, sf), ["seller_id"])


@query(_EVENTS + " SELECT kind, count(*) AS n FROM ev GROUP BY 1")
def change_event_summary(spark, sf):
    return change_events(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


def _series(period: str):
    def run(spark, sf):
        a = accounts(spark, sf)
        return series.fill_gaps(series.period_counts(a, "app", "installed_d", period), a, "app", period)

    return run


_KEY = {"month": "strftime(start, '%Y-%m')", "quarter": "year(start) || '-Q' || quarter(start)", "year": "CAST(year(start) AS VARCHAR)"}


def _series_sql(period: str) -> str:
    step = {"month": "1 month", "quarter": "3 months", "year": "1 year"}[period]
    return f"""WITH {_ACC}, c AS (SELECT app, date_trunc('{period}', installed_d)::DATE AS start, count(*) AS n FROM acc GROUP BY 1, 2),
 spine AS (SELECT unnest(generate_series((SELECT min(start) FROM c)::TIMESTAMP, (SELECT max(start) FROM c)::TIMESTAMP, INTERVAL {step}))::DATE AS start),
 d AS (SELECT app, start, coalesce(n, 0) AS n FROM (SELECT DISTINCT app FROM acc) CROSS JOIN spine LEFT JOIN c USING (app, start)),
 s AS (SELECT app, {_KEY[period]} AS period, n FROM d UNION ALL SELECT 'all_apps', {_KEY[period]}, sum(n)::BIGINT FROM d GROUP BY start)"""


for _p in ("month", "quarter", "year"):
    QUERIES[f"{_p}ly_series"], ORACLE_SQL[f"{_p}ly_series"] = _series(_p), _series_sql(_p) + " SELECT * FROM s"


@query(_series_sql("month") + " SELECT *, 100 * ((n - lag(n) OVER w)::DOUBLE / nullif(lag(n) OVER w, 0)) AS growth_pct FROM s WINDOW w AS (PARTITION BY app ORDER BY period)")
def growth_rates(spark, sf):
    return series.growth(_series("month")(spark, sf), "app")


@query(_series_sql("month") + " SELECT *, sum(n) OVER (PARTITION BY app ORDER BY period ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM s")
def cumulative_installs(spark, sf):
    return series.cumulative(_series("month")(spark, sf), "app")


@query(_series_sql("quarter") + " SELECT DISTINCT period, substr(period, 6, 2) || ' ' || left(period, 4) AS label FROM s")
def period_labels(spark, sf):
    return _series("quarter")(spark, sf).select("period", period_label(F.col("period"), "quarter").alias("label")).distinct()


@query("SELECT event_type, date_trunc('month', ts)::DATE AS start, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2")
def distinct_per_period(spark, sf):
    return series.period_counts(table(spark, sf, "events"), "event_type", "ts", "month", "user_id")


@query(f"""WITH {_ACC}, spine AS (SELECT unnest(generate_series(DATE '1995-06-30' - INTERVAL 90 DAY, TIMESTAMP '1995-06-30', INTERVAL 1 DAY))::DATE AS day)
 SELECT g.app, s.day, count(a.seller_id) AS n FROM (SELECT DISTINCT app FROM acc) g CROSS JOIN spine s LEFT JOIN acc a ON a.app = g.app AND a.installed_d <= s.day AND a.installed_d > s.day - 30 GROUP BY 1, 2""")
def rolling_velocity(spark, sf):
    return series.rolling(accounts(spark, sf), "app", "installed_d", "1995-06-30")


def _breakdown_sql(label: str) -> str:
    return f"""WITH {_ACC}, l AS (SELECT app, {label} AS label FROM acc), b AS (SELECT app, label, count(*) AS n FROM l GROUP BY 1, 2 UNION ALL SELECT 'all_apps', label, count(*) FROM l GROUP BY 2)
 SELECT app, label, n, 100.0::DOUBLE * (sum(CASE WHEN label <> '(not set)' THEN n ELSE 0 END) OVER (PARTITION BY app))::DOUBLE / (sum(n) OVER (PARTITION BY app))::DOUBLE AS coverage_pct FROM b"""


@query(_breakdown_sql("CASE WHEN plan = '' THEN '(not set)' ELSE plan END"))
def dimension_breakdown(spark, sf):
    return segments.breakdown(accounts(spark, sf), "app", "plan").withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


@query(_breakdown_sql("country"))
def country_breakdown(spark, sf):
    return segments.breakdown(accounts(spark, sf), "app", "country").withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


@query(f"WITH {_ACC} SELECT app, strftime(installed_d, '%Y-%m') AS month, steps, count(*) AS n FROM acc GROUP BY 1, 2, 3")
def steps_matrix(spark, sf):
    return accounts(spark, sf).groupBy("app", F.date_format("installed_d", "yyyy-MM").alias("month"), "steps").agg(F.count("*").alias("n"))


def _bucket_sql(src: str, col: str) -> str:
    return f"""b AS (SELECT unnest(['0', '1-10', '11-100', '101-1k', '1k+']) AS bucket) SELECT g.app, b.bucket, count(x.app) AS n FROM (SELECT DISTINCT app FROM {src}) g CROSS JOIN b
 LEFT JOIN (SELECT app, CASE WHEN {col} = 0 THEN '0' WHEN {col} <= 10 THEN '1-10' WHEN {col} <= 100 THEN '11-100' WHEN {col} <= 1000 THEN '101-1k' ELSE '1k+' END AS bucket FROM {src}) x ON x.app = g.app AND x.bucket = b.bucket GROUP BY 1, 2"""


@query(f"WITH {_ACC}, " + _bucket_sql("acc", "orders"))
def order_segmentation(spark, sf):
    return segments.bucket_counts(accounts(spark, sf), "app", "orders")


@query(f"WITH {_ACC}, {_PROD}, " + _bucket_sql("prod", "products"))
def product_segmentation(spark, sf):
    return segments.bucket_counts(with_products(spark, sf, accounts(spark, sf)), "app", "products")


@query(f"WITH {_ACC} SELECT app, count(*) FILTER (WHERE orders = 0) AS zero, count(*) FILTER (WHERE orders > 0) AS active, count(*) FILTER (WHERE failed > 0) AS with_failed, sum(orders)::BIGINT AS orders, sum(failed)::BIGINT AS failed, count(*) AS total FROM acc GROUP BY 1")
def order_activity(spark, sf):
    return segments.activity(accounts(spark, sf), "app")


@query(f"WITH {_ACC}, k AS (SELECT *, {_CLASS} AS k FROM acc) SELECT app, count(*) FILTER (WHERE k = 'Paid') AS paid, count(*) FILTER (WHERE k = 'Free') AS free, count(*) FILTER (WHERE k = 'Not Paid') AS not_paid, count(*) AS total FROM k GROUP BY 1")
def paid_breakdown(spark, sf):
    return segments.class_counts(accounts(spark, sf), "app", scores.plan_class(F.col("plan")), ["Paid", "Free", "Not Paid"])


@query(f"WITH {_ACC}, {_PROD} SELECT {_CLASS} AS plan_class, count(*) FILTER (WHERE orders > 0) AS active, count(*) AS total, sum(orders)::BIGINT AS orders, sum(products)::BIGINT AS products FROM prod GROUP BY 1")
def activity_by_paid(spark, sf):
    return with_products(spark, sf, accounts(spark, sf)).groupBy(scores.plan_class(F.col("plan")).alias("plan_class")).agg(F.count_if(F.col("orders") > 0).alias("active"), F.count("*").alias("total"), F.sum("orders").alias("orders"), F.sum("products").alias("products"))


@query(f"WITH {_DEP} SELECT app, platform, count(*) AS n FROM dep GROUP BY 1, 2 UNION ALL SELECT 'all_apps', platform, count(*) FROM dep GROUP BY 2")
def platform_split(spark, sf):
    d = departures(spark, sf).groupBy("app", text.platform_slug(F.col("platform")).alias("platform")).agg(F.count("*").alias("n"))
    return d.unionByName(d.groupBy("platform").agg(F.sum("n").alias("n")).withColumn("app", F.lit("all_apps")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1998")
def year_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return o.where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages WHERE NOT regexp_matches(lower(regexp_extract(url, '^https?://([^/]*)', 1)), '(test|demo|dev|staging|sandbox)([-_.]|$)')")
def test_row_filter(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"))
    return p.where(~text.is_test_name(F.col("host")))


_DAYS = f"CAST(DATE '{AS_OF}' - installed_d AS INT)"
_FIT = f"""CAST(greatest(0, least(100, round_even(CASE WHEN {_IS_PAID} THEN 30.0::DOUBLE + least(50.0::DOUBLE, orders / 10.0::DOUBLE) + least(20.0::DOUBLE, products / 50.0::DOUBLE) - CASE WHEN failed::DOUBLE / nullif(orders, 0) > 0.1 THEN 15.0 ELSE 0.0 END
 ELSE least(35.0::DOUBLE, {_DAYS} / 4.3::DOUBLE) + least(30.0::DOUBLE, products / 20.0::DOUBLE) + least(30.0::DOUBLE, orders * 2.0::DOUBLE) + least(5.0::DOUBLE, (orders % 5)::DOUBLE) END, 0))) AS INT)"""


def _fit(spark, sf):
    a = with_products(spark, sf, accounts(spark, sf)).withColumn("days", F.datediff(F.lit(AS_OF).cast("date"), "installed_d")).withColumn("paid", scores.is_paid(F.col("plan")))
    return a.withColumn("score", scores.fit_score(F.col("paid"), F.col("days"), F.col("products"), F.col("orders"), F.col("failed"), F.col("orders") % 5))


@query(f"WITH {_ACC}, {_PROD} SELECT seller_id, {_FIT} AS score FROM prod")
def fit_score(spark, sf):
    return _fit(spark, sf).select("seller_id", "score")


@query(f"WITH {_ACC}, {_PROD}, f AS (SELECT {_FIT} AS score FROM prod) SELECT CASE WHEN score >= 75 THEN 'Hot' WHEN score >= 50 THEN 'Warm' WHEN score >= 25 THEN 'Cool' ELSE 'Low' END AS tier, count(*) AS n FROM f GROUP BY 1")
def tier_counts(spark, sf):
    return _fit(spark, sf).groupBy(scores.temperature(F.col("score")).alias("tier")).agg(F.count("*").alias("n"))


@query(f"""WITH {_ACC}, {_PROD}, x AS (SELECT *, {_IS_PAID} AS paid, {_DAYS} AS days FROM prod) SELECT seller_id, 'priority' AS rule FROM x WHERE NOT paid AND days >= 60 AND (orders > 0 OR products > 0 OR orders % 5 >= 1)
 UNION ALL SELECT seller_id, 'free_with_orders' FROM x WHERE NOT paid AND orders > 0 UNION ALL SELECT seller_id, 'heavy_catalogue' FROM x WHERE NOT paid AND products >= 500
 UNION ALL SELECT seller_id, 'upsell' FROM x WHERE paid AND orders >= 200 UNION ALL SELECT seller_id, 'churn_risk' FROM x WHERE failed >= 10 OR (orders > 0 AND failed::DOUBLE / orders >= 0.1)""")
def lead_rules(spark, sf):
    return segments.lead_rules(_fit(spark, sf).withColumn("steps", F.col("orders") % 5))


# subscriptions: accounts that ordered in the last year before the day are installed
_SUB = f"""{_ACC}, sub AS (SELECT *, CAST(DATE '{AS_OF}' - last_d AS INT) AS idle_days, last_d >= DATE '2000-08-02' AS installed, {_IS_PAID} AS paying, {_IS_PAID} AS ever_paid, orders * 37 % 120 AS days_to_expiration,
 CASE WHEN plan LIKE 'Standard%' THEN 'Standard' WHEN plan LIKE 'Lite%' THEN 'Lite' WHEN plan = 'Premium' THEN 'Premium' WHEN plan = 'Free Trial' THEN 'Trial' WHEN plan = 'Free' THEN 'Free' ELSE '' END AS tier,
 CASE WHEN plan LIKE 'Standard%' THEN 100.0 WHEN plan LIKE 'Lite%' THEN 30.0 WHEN plan = 'Premium' THEN 49.0 ELSE 0.0 END::DOUBLE AS mrr, CASE WHEN orders > 0 THEN failed::DOUBLE / orders ELSE 0.0 END AS failure_rate FROM acc)"""


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    a = accounts(spark, sf).withColumn("p", scores.parse_plan(F.col("plan"), {"premium": 49.0}))
    paid = scores.is_paid(F.col("plan"))
    return a.select(
        "*", F.datediff(F.lit(AS_OF).cast("date"), "last_d").alias("idle_days"), (F.col("last_d") >= F.lit("2000-08-02").cast("date")).alias("installed"), paid.alias("paying"), paid.alias("ever_paid"),
        (F.col("orders") * 37 % 120).alias("days_to_expiration"), F.col("p.label").alias("tier"), F.col("p.monthly_usd").alias("mrr"),
        F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("orders").cast("double")), F.lit(0.0)).alias("failure_rate"),
    )


@query(f"WITH {_SUB} SELECT seller_id, CASE WHEN plan = 'Free Trial' THEN 'Trial' ELSE tier END AS label, CASE WHEN plan LIKE '%Yearly' THEN 12 WHEN plan LIKE '%Monthly' THEN 1 ELSE 0 END AS period_months, CASE WHEN plan LIKE 'Standard%' THEN 1200.0::DOUBLE WHEN plan LIKE 'Lite%' THEN 30.0::DOUBLE END AS price_usd, mrr AS monthly_usd FROM sub")
def parse_plan(spark, sf):
    return subscriptions(spark, sf).select("seller_id", "p.*")


@query(f"WITH {_SUB} SELECT CASE WHEN tier = '' THEN 'Unknown tier' ELSE tier END AS tier, count(*) AS sellers, count(*) FILTER (WHERE mrr <= 0) AS unpriced, sum(mrr) AS mrr, sum(mrr) * 12 AS arr FROM sub WHERE installed AND paying GROUP BY 1")
def mrr_by_tier(spark, sf):
    return revenue.mrr_by_tier(subscriptions(spark, sf))


@query(f"WITH {_SUB}, a AS (SELECT strftime(installed_d, '%Y-%m') AS month, count(*) AS new FROM sub GROUP BY 1), b AS (SELECT strftime(last_d, '%Y-%m') AS month, count(*) AS churned FROM sub WHERE NOT installed GROUP BY 1) SELECT month, coalesce(new, 0) AS new, coalesce(churned, 0) AS churned, coalesce(new, 0) - coalesce(churned, 0) AS net FROM a FULL JOIN b USING (month)")
def movement_series(spark, sf):
    s = subscriptions(spark, sf)
    return revenue.movement(s, s.where("not installed"), "installed_d", "last_d")


@query(f"WITH {_SUB} SELECT country, count(*) AS sellers, count(*) FILTER (WHERE installed) AS installed, count(*) FILTER (WHERE installed AND paying) AS paid FROM sub GROUP BY 1")
def country_distribution(spark, sf):
    return subscriptions(spark, sf).groupBy("country").agg(F.count("*").alias("sellers"), F.count_if("installed").alias("installed"), F.count_if(F.col("installed") & F.col("paying")).alias("paid"))


@query(f"WITH {_SUB}, c AS (SELECT strftime(installed_d, '%Y-%m') AS month, count(*) AS installs, count(*) FILTER (WHERE ever_paid) AS ever_paid, count(*) FILTER (WHERE installed AND paying) AS still_paid FROM sub GROUP BY 1) SELECT *, round(100.0::DOUBLE * ever_paid / installs, 1) AS ever_paid_pct, round(100.0::DOUBLE * still_paid / installs, 1) AS still_paid_pct FROM c")
def cohort_table(spark, sf):
    return revenue.cohorts(subscriptions(spark, sf)).select("month", "installs", "ever_paid", "still_paid", *(F.col(c).cast("double").alias(c) for c in ("ever_paid_pct", "still_paid_pct")))


@query(f"WITH {_SUB}, b AS (SELECT * FROM (VALUES (0, 7), (8, 14), (15, 30), (31, 60), (61, 90)) v(a, z)) SELECT a || '-' || z AS band, count(seller_id) AS sellers, coalesce(sum(mrr), 0.0) AS mrr FROM b LEFT JOIN (SELECT * FROM sub WHERE installed AND paying) s ON days_to_expiration BETWEEN a AND z GROUP BY 1")
def renewal_forecast(spark, sf):
    return revenue.renewals(subscriptions(spark, sf))


_HEALTH = "CAST(least(100, round_even(CASE WHEN idle_days <= 7 THEN 40 WHEN idle_days <= 30 THEN 25 WHEN idle_days <= 60 THEN 12 ELSE 0 END + 30.0::DOUBLE * (1 - least(failure_rate, 1.0)) + CASE WHEN orders % 5 = 4 THEN 15 ELSE 5 END + CASE WHEN days_to_expiration >= 60 THEN 15 WHEN days_to_expiration >= 30 THEN 10 WHEN days_to_expiration >= 14 THEN 5 ELSE 0 END, 0)) AS INT)"


def _healthy(spark, sf):
    return subscriptions(spark, sf).withColumn("health", scores.health_score(F.col("idle_days"), F.col("failure_rate"), F.col("orders") % 5 == 4, F.col("days_to_expiration")))


@query(f"WITH {_SUB}, h AS (SELECT {_HEALTH} AS health, mrr FROM sub WHERE installed AND paying) SELECT greatest(0, CAST(ceil(health / 10.0) AS INT) - 1) AS band, count(*) AS sellers, sum(mrr) AS mrr FROM h GROUP BY 1")
def health_histogram(spark, sf):
    return revenue.score_bands(_healthy(spark, sf).where("installed and paying"), "health")


@query(f"WITH {_SUB} SELECT seller_id, {_HEALTH} AS health, round(mrr * (100 - {_HEALTH}), 1) AS risk FROM sub WHERE installed AND paying AND mrr > 0")
def churn_risk_list(spark, sf):
    return _healthy(spark, sf).where("installed and paying and mrr > 0").select("seller_id", "health", F.round(F.col("mrr") * (100 - F.col("health")), 1).alias("risk"))


@query(f"WITH {_SUB} SELECT country AS segment, count(*) AS sellers, sum(orders)::BIGINT AS orders, sum(failed)::BIGINT AS failed, sum(failed)::DOUBLE / sum(orders)::DOUBLE AS failure_rate FROM sub GROUP BY 1 HAVING count(*) >= 10 AND sum(orders) >= 200")
def failure_by_segment(spark, sf):
    return revenue.failure_by_segment(subscriptions(spark, sf), "country")


@query("""WITH h AS (SELECT o_custkey, o_orderpriority AS a, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
 SELECT a AS source, b AS target, count(*) AS n FROM h WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2 ORDER BY n DESC, source, target LIMIT 20""")
def plan_flow(spark, sf):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.lead("o_orderpriority").over(by).alias("target"))
    return revenue.top_flows(steps)


_DIFF = f"""WITH {_SNAPS} SELECT coalesce(c.seller_id, p.seller_id) AS seller_id, CASE WHEN p.seller_id IS NULL THEN 'added' WHEN c.seller_id IS NULL THEN 'removed' WHEN c.plan <> p.plan THEN 'plan_changed' ELSE 'same' END AS status,
 p.plan AS plan_before, c.plan AS plan_after, coalesce(c.spend, 0) - coalesce(p.spend, 0) AS mrr_delta FROM cur c FULL JOIN prev p ON c.seller_id = p.seller_id"""


@query(_DIFF)
def snapshot_diff(spark, sf):
    return snapshots.snapshot_diff(*(d.withColumnRenamed("spend", "mrr") for d in _pair(spark, sf)), "seller_id")


@query(f"SELECT status, count(*) AS n FROM ({_DIFF}) GROUP BY 1")
def snapshot_diff_summary(spark, sf):
    return snapshot_diff(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_ACC}, r AS (SELECT CAST(spend AS DECIMAL(18,2)) AS v, row_number() OVER (ORDER BY CAST(spend AS DECIMAL(18,2)) DESC, seller_id) AS rank FROM acc WHERE spend > 0), t AS (SELECT count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM r),
 c AS (SELECT unnest([1, 5, 10, 20]) AS top_pct) SELECT top_pct, greatest(1, CAST(round_even(n * top_pct / 100.0::DOUBLE, 0) AS BIGINT)) AS rows, round((SELECT CAST(sum(v) AS DOUBLE) FROM r WHERE rank <= greatest(1, CAST(round_even(n * top_pct / 100.0::DOUBLE, 0) AS BIGINT))) / total, 4) AS share FROM c, t""")
def revenue_concentration(spark, sf):
    return revenue.concentration(accounts(spark, sf), "seller_id", "spend")


@query(f"WITH {_ACC} SELECT seller_id, spend FROM acc ORDER BY spend DESC, seller_id LIMIT 25")
def top_accounts(spark, sf):
    return accounts(spark, sf).select("seller_id", "spend").orderBy(F.desc("spend"), "seller_id").limit(25)


@query(f"WITH {_ACC}, {_PROD} SELECT seller_id, orders + least(products, 1000) AS upsell FROM prod WHERE {_CLASS} = 'Free' ORDER BY upsell DESC, orders DESC, seller_id LIMIT 20")
def upsell_list(spark, sf):
    a = with_products(spark, sf, accounts(spark, sf)).where(scores.plan_class(F.col("plan")) == "Free")
    return a.select("seller_id", (F.col("orders") + F.least("products", F.lit(1000))).alias("upsell"), "orders").orderBy(F.desc("upsell"), F.desc("orders"), "seller_id").limit(20).drop("orders")


_LN = "ln(1 + {})"


@query(f"WITH {_ACC}, {_PROD}, x AS (SELECT *, {_DAYS} AS age, CAST(DATE '{AS_OF}' - last_d AS INT) AS idle FROM prod) SELECT seller_id, CAST(round_even(least(40.0::DOUBLE, 8 * ln(1 + orders)) + least(30.0::DOUBLE, 5 * ln(1 + products)) + CASE WHEN age BETWEEN 30 AND 365 THEN 15 WHEN age >= 7 THEN 8 ELSE 0 END + CASE WHEN idle BETWEEN 1 AND 14 THEN 15 ELSE 0 END, 0) AS INT) AS score FROM x")
def opportunity_score(spark, sf):
    a = with_products(spark, sf, accounts(spark, sf))
    day = F.lit(AS_OF).cast("date")
    return a.select("seller_id", scores.opportunity_score(F.col("orders"), F.col("products"), F.datediff(day, "installed_d"), F.datediff(day, "last_d")).alias("score"))


@query(f"WITH {_SUB} SELECT seller_id, CAST(CASE WHEN NOT installed AND paying THEN round_even(least(35.0::DOUBLE, 7.0::DOUBLE * (orders % 5)) + least(35.0::DOUBLE, 6 * ln(1 + orders)) + CASE WHEN idle_days <= 30 THEN 30 WHEN idle_days <= 90 THEN 22 WHEN idle_days <= 180 THEN 15 WHEN idle_days <= 365 THEN 8 ELSE 0 END, 0) ELSE 0 END AS INT) AS score FROM sub")
def winback_score(spark, sf):
    s = subscriptions(spark, sf)
    return s.select("seller_id", scores.winback_score(~F.col("installed") & F.col("paying"), F.col("orders") % 5, F.col("orders"), F.col("idle_days")).alias("score"))


@query(f"""WITH {_SUB}, x AS (SELECT *, {_DAYS} AS age, CASE WHEN paying AND installed THEN 'Purchased' WHEN paying THEN 'License Expired' WHEN plan = 'Free Trial' THEN 'Trial Expired' WHEN plan = 'Free' THEN 'Free Subscription' ELSE '' END AS status FROM sub)
 SELECT seller_id, CASE WHEN status = 'Purchased' AND installed AND days_to_expiration BETWEEN 0 AND 14 THEN 'renewal_at_risk' WHEN status = 'Trial Expired' AND installed AND orders >= 1 THEN 'trial_conversion' WHEN status = 'Free Subscription' AND installed AND orders >= 10 THEN 'upgrade_ready'
 WHEN status = 'License Expired' AND (orders >= 50 OR orders % 5 >= 2) THEN 'winback_high_value' WHEN status = 'Purchased' AND installed AND idle_days >= 30 THEN 'paid_idle' WHEN status = 'Purchased' AND installed AND failure_rate >= 0.2 AND orders >= 10 THEN 'failure_spike'
 WHEN installed AND status <> 'Purchased' AND orders % 3 >= 1 THEN 'cross_sell_oldapps' WHEN installed AND orders % 7 = 0 THEN 'reinstall_committed' WHEN installed AND age BETWEEN 7 AND 60 AND orders % 5 <> 4 THEN 'stuck_onboarding' END AS bucket FROM x""")
def lead_bucket(spark, sf):
    s, o = subscriptions(spark, sf), F.col("orders")
    status = F.when(F.col("paying") & F.col("installed"), "Purchased").when(F.col("paying"), "License Expired").when(F.col("plan") == "Free Trial", "Trial Expired").when(F.col("plan") == "Free", "Free Subscription").otherwise("")
    return s.select("seller_id", scores.lead_bucket({
        "status": status, "installed": F.col("installed"), "reinstalled": o % 7 == 0, "orders": o, "skus": F.lit(0), "history": o % 5, "other_apps": o % 3, "failure_rate": F.col("failure_rate"), "idle_days": F.col("idle_days"),
        "days_to_expiration": F.col("days_to_expiration"), "age_days": F.datediff(F.lit(AS_OF).cast("date"), "installed_d"), "onboarding": F.when(o % 5 == 4, "COMPLETE").otherwise("STARTED"),
    }).alias("bucket"))


_DEPK = f"{_DEP}, first AS (SELECT * FROM dep QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY left_on, pos) = 1)"


@query(f"""WITH {_ACC}, {_DEPK} SELECT f.seller_id, f.platform, coalesce(a.app, b.app) AS matched_app FROM first f LEFT JOIN (SELECT * FROM acc WHERE seller_id % 2 = 0) a ON a.seller_id = f.seller_id LEFT JOIN (SELECT country, arg_max(app, seller_id) AS app FROM acc GROUP BY 1) b ON b.country = 'NATION_' || f.platform""")
def fallback_join(spark, sf):
    d = snapshots.keep_one(departures(spark, sf), ["seller_id"], F.col("left_on"), F.col("pos"))
    d = d.select("seller_id", "platform", F.col("seller_id").cast("string").alias("k1"), F.concat(F.lit("NATION_"), "platform").alias("k2"))
    a = accounts(spark, sf).select("app", "seller_id", "country", F.when(F.col("seller_id") % 2 == 0, F.col("seller_id").cast("string")).alias("even"))
    return snapshots.fallback_join(d, a, [("k1", "even"), ("k2", "country")], ["app"], F.col("seller_id")).select("seller_id", "platform", "matched_app")


@query(f"WITH {_ACC}, {_DEP} SELECT seller_id, country FROM acc WHERE CAST(seller_id AS VARCHAR) IN (SELECT CAST(seller_id AS VARCHAR) FROM dep) OR steps IN (SELECT platform FROM dep)")
def reinstalls(spark, sf):
    a = accounts(spark, sf).withColumn("k", F.col("seller_id").cast("string"))
    d = departures(spark, sf).select(F.col("seller_id").cast("string").alias("k1"), F.col("platform").alias("k2"))
    return snapshots.any_key_semi(a, d, [("k", "k1"), ("steps", "k2")], "seller_id").select("seller_id", "country")


@query(f"WITH {_SNAPS}, {_DEP} SELECT seller_id FROM prev ANTI JOIN cur USING (seller_id) ANTI JOIN dep USING (seller_id)")
def ghost_detection(spark, sf):
    cur, prev = _pair(spark, sf)
    return snapshots.churned_rows(cur, prev, ["seller_id"]).join(departures(spark, sf).select("seller_id").distinct(), "seller_id", "left_anti").select("seller_id")


@query(f"WITH {_DEP}, s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-13', TIMESTAMP '2024-01-20', INTERVAL 1 DAY))::DATE AS day) SELECT day, count(pos) AS n FROM s LEFT JOIN dep ON CAST(left_on AS DATE) = day GROUP BY 1")
def seven_day(spark, sf):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-13").cast("date"), F.lit("2024-01-20").cast("date"))).alias("day"))
    return days.join(departures(spark, sf).withColumn("day", F.to_date("left_on")), "day", "left").groupBy("day").agg(F.count("pos").alias("n"))


for _name, _order in (("dedupe_first", "ts ASC, event_id ASC"), ("dedupe_last", "ts DESC, event_id DESC"), ("dedupe_earliest", "CAST(ts AS DATE) ASC, event_id ASC")):
    ORACLE_SQL[_name] = f"SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_order}) = 1"


@query(ORACLE_SQL["dedupe_first"])
def dedupe_first(spark, sf):
    return snapshots.keep_one(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], F.col("ts"), F.col("event_id")).drop("ts")


@query(ORACLE_SQL["dedupe_last"])
def dedupe_last(spark, sf):
    return snapshots.keep_one(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], F.col("ts"), F.col("event_id"), last=True).drop("ts")


@query(ORACLE_SQL["dedupe_earliest"])
def dedupe_earliest(spark, sf):
    return snapshots.keep_one(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], F.to_date("ts"), F.col("event_id")).drop("ts")


@query("SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/]*)', 1)), '^www\\.', '') || regexp_extract(u, '^[^/]*(.*)$', 1), '/$', '') AS url FROM (SELECT page_id, regexp_replace(trim(url), '^https?://', '', 'i') AS u FROM pages)")
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.store_url(F.col("url")).alias("url"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS clean FROM documents")
def whitespace_norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_whitespace(F.col("text"))).alias("clean"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(html) AS n FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), F.length("html").cast("long").alias("n"))


@query(r"""WITH b AS (SELECT page_id, coalesce(html, '') AS h FROM pages), t AS (SELECT *, regexp_replace(h, '(?is)<noscript(?:[\s/][^>]*)?>.*?</noscript\s*>|<script(?:[\s/][^>]*)?>.*?</script\s*>|<style(?:[\s/][^>]*)?>.*?</style\s*>', ' ', 'g') AS bare FROM b)
 SELECT page_id, trim(regexp_extract(h, '(?is)<title(?:[\s/][^>]*)?>(.*?)</title\s*>', 1)) AS title, regexp_replace(regexp_extract(h, '(?i)<meta[^>]*(?:name|property)=["''](?:og:)?description["''][^>]*content=["'']([^"'']*)', 1), '^\s+|\s+$', '', 'g') AS description,
 trim(regexp_replace(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM t""")
def html_text(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", text.html_title(html).alias("title"), text.html_description(html).alias("description"), text.html_to_text(html).alias("body"))


@query("SELECT event_id, unnest(range(3)) AS k, 'P' || unnest(range(3)) || ' ' || strftime(ts, '%Y-%m-%d') AS piece FROM events WHERE event_type = 'error'")
def nested_explode(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    cell = F.concat_ws(" ", *(F.concat(F.lit(f"P{i} "), F.date_format("ts", "yyyy-MM-dd")) for i in range(3)))
    parts = F.regexp_extract_all(cell, F.lit(r"(P\d \d{4}-\d{2}-\d{2})"), F.lit(1))
    return e.select("event_id", F.posexplode_outer(parts).alias("k", "piece")).withColumn("k", F.col("k").cast("long"))


@query(f"WITH {_SNAPS}, a AS (SELECT app, count(*) AS rows FROM cur GROUP BY 1), b AS (SELECT app, count(*) AS before FROM prev GROUP BY 1) SELECT app, rows, before, CASE WHEN (before - rows)::DOUBLE / before > 0.5 THEN 'blocked' WHEN (before - rows)::DOUBLE / before > 0.2 THEN 'pending_review' ELSE 'ok' END AS status FROM a JOIN b USING (app)")
def row_count_gate(spark, sf):
    return store.row_count_gate(*_pair(spark, sf), "app")


@query("WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id FROM events) SELECT user_id, count(*) AS pages, count(*) * 10 AS scraped, max(pos) * 10 AS reported, true AS ok FROM t GROUP BY 1")
def pagination_gate(spark, sf):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = table(spark, sf, "events").select("user_id", pos.cast("long").alias("pos"), F.col("event_id").alias("first_key"), F.lit(10).alias("rows"))
    return store.pagination_gate(t.withColumn("page_num", F.col("pos")).withColumn("reported", F.col("pos") * 10), "user_id")


@query(f"WITH {_SNAPS} SELECT coalesce(c.seller_id, p.seller_id) AS seller_id, CASE WHEN c.seller_id IS NOT NULL AND (p.seller_id IS NULL OR p.seller_id % 10 <> 0) THEN c.plan ELSE p.plan END AS plan, CASE WHEN p.seller_id % 10 = 0 THEN 1 END AS locked, CASE WHEN c.seller_id IS NOT NULL THEN 2 ELSE 1 END AS last_seen FROM prev p FULL JOIN cur c ON c.seller_id = p.seller_id")
def guarded_upsert(spark, sf):
    cur, prev = _pair(spark, sf)
    stored = prev.select("seller_id", "plan", F.when(F.col("seller_id") % 10 == 0, 1).alias("locked"), F.lit(1).alias("last_seen"))
    return store.guarded_upsert(stored, cur.select("seller_id", "plan", F.lit(2).alias("last_seen")), ["seller_id"], ["plan"])


@query("WITH e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events GROUP BY 1) SELECT c_custkey, coalesce(v, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN e ON user_id = c_custkey")
def manual_overlay(spark, sf):
    edits = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), F.lit("c_mktsegment").alias("field"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("edited_at"))
    return store.overlay_edits(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), edits, ["c_custkey"], ["c_mktsegment"])


@query(f"WITH {_SNAPS}, t AS (SELECT * FROM cur WHERE app <> 'BUILDING') SELECT * FROM t UNION ALL SELECT * FROM prev WHERE app NOT IN (SELECT app FROM t)")
def merge_forward(spark, sf):
    cur, prev = _pair(spark, sf)
    return store.merge_forward(cur.where("app <> 'BUILDING'"), prev, None, "app")


@query("SELECT user_id, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-28'")
def active_sessions(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return e.where(F.col("last_seen") >= F.lit("2024-01-28").cast("timestamp_ntz"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def activity_kpis(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(f"""WITH {_SNAPS}, u AS (SELECT seller_id, 'plan' AS field, plan AS v FROM cur UNION ALL SELECT seller_id, 'orders', CAST(orders AS VARCHAR) FROM cur), o AS (SELECT seller_id, 'plan' AS field, plan AS v FROM prev UNION ALL SELECT seller_id, 'orders', CAST(orders AS VARCHAR) FROM prev)
 SELECT seller_id, field, o.v AS before, u.v AS after FROM u JOIN o USING (seller_id, field) WHERE nullif(trim(u.v), '') IS DISTINCT FROM nullif(trim(o.v), '')""")
def cell_diff(spark, sf):
    cur, prev = _pair(spark, sf)
    return store.cell_diff(cur, prev, ["seller_id"], ["plan", "orders"])


@query("SELECT 'lang' AS field, count(*) FILTER (WHERE trim(lang) <> '') AS populated, count(*) AS total FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE trim(source) <> ''), count(*) FROM documents")
def populated_columns(spark, sf):
    return store.populated(table(spark, sf, "documents"), ["lang", "source"])


@query("SELECT user_id, min(ts) AS started_at, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS page FROM events GROUP BY 1")
def session_heartbeats(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("page"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def page_changes(spark, sf):
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").withColumn("before", before)
    return e.where(~F.col("event_type").eqNullSafe(F.col("before"))).select("event_id", "user_id", "event_type")


@query(_series_sql("month") + " SELECT app, period, n FROM s WHERE period <= '1998-06' QUALIFY row_number() OVER (PARTITION BY app ORDER BY period DESC) <= 12")
def period_clip(spark, sf):
    from pyspark.sql import Window

    s = _series("month")(spark, sf).where("period <= '1998-06'")
    return s.withColumn("r", F.row_number().over(Window.partitionBy("app").orderBy(F.desc("period")))).where("r <= 12").drop("r")


@query(f"WITH {_ACC} SELECT plan, count(*) AS n FROM acc WHERE plan NOT IN ('', 'N/A') GROUP BY 1 ORDER BY n DESC, plan LIMIT 20")
def plan_top(spark, sf):
    return segments.top_labels(accounts(spark, sf).where(~F.col("plan").isin("", "N/A")), "plan", 20)


@query(f"WITH {_ACC} SELECT country, count(*) AS n FROM acc GROUP BY 1 ORDER BY n DESC, country LIMIT 15")
def country_top(spark, sf):
    return segments.top_labels(accounts(spark, sf), "country", 15)


@query("WITH r AS (SELECT event_type AS app, CAST(ts AS DATE) AS d FROM events), s AS (SELECT DISTINCT app, d FROM r QUALIFY dense_rank() OVER (PARTITION BY app ORDER BY d DESC) <= 2) SELECT app, CAST(min(d) AS VARCHAR) AS run_stamp, count(*) AS rows FROM r SEMI JOIN (SELECT app, min(d) AS d FROM s GROUP BY 1) USING (app, d) GROUP BY 1")
def previous_snapshot(spark, sf):
    from tidemark.sources.runs import previous_snapshot as previous

    e = table(spark, sf, "events").select(F.col("event_type").alias("app"), F.date_format("ts", "yyyy-MM-dd").alias("run_stamp"))
    return previous(e).groupBy("app", "run_stamp").agg(F.count("*").alias("rows"))


@query(f"WITH {_SNAPS}, p AS (SELECT seller_id, app, plan, 0 AS pass FROM cur WHERE orders > 1 UNION ALL SELECT seller_id, app, plan, 1 FROM prev) SELECT seller_id, app, plan, pass FROM p QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY pass) = 1")
def multi_pass_merge(spark, sf):
    cur, prev = _pair(spark, sf)
    return snapshots.merged_passes([d.select("seller_id", "app", "plan") for d in (cur.where("orders > 1"), prev)], ["seller_id"], F.col("app"), F.col("plan"))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def key_intersection(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'purchase'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query(f"WITH {_SUB}, h AS (SELECT {_HEALTH} AS health, tier, mrr FROM sub WHERE installed AND paying) SELECT tier, count(*) AS sellers, sum(mrr) AS mrr, sum(mrr) / nullif(count(*), 0) AS arpa FROM h GROUP BY 1")
def tier_mix(spark, sf):
    s = subscriptions(spark, sf).where("installed and paying").groupBy("tier").agg(F.count("*").alias("sellers"), revenue.money("mrr").alias("mrr"))
    return s.withColumn("arpa", F.try_divide("mrr", F.col("sellers").cast("double")))


@query(f"WITH {_SUB} SELECT count(*) FILTER (WHERE installed) AS installed, count(*) FILTER (WHERE installed AND paying) AS purchased, count(*) FILTER (WHERE NOT installed) AS departed, round(100.0::DOUBLE * count(*) FILTER (WHERE installed AND paying) / nullif(count(*) FILTER (WHERE installed), 0), 1) AS paid_pct FROM sub")
def headline_kpis(spark, sf):
    paid = F.col("installed") & F.col("paying")
    s = subscriptions(spark, sf).agg(F.count_if("installed").alias("installed"), F.count_if(paid).alias("purchased"), F.count_if(~F.col("installed")).alias("departed"))
    return s.withColumn("paid_pct", F.round(F.try_divide(100.0 * F.col("purchased"), F.col("installed").cast("double")), 1))
