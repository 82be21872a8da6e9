"""Registered queries over rows as sources give them: grids, headers, dialects, payloads, stored runs, odd groups and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text
from tidemark.operators import leads, payload, rows, segments, series, snapshots, store
from tidemark.plans import queries as base
from tidemark.plans.queries import _ACC, _DEP, _SNAPS, query
from tidemark.sources import grids, runs
from tidemark.sources.files import shared_folder
from tidemark.sources.tables import AS_OF, accounts, departures, table
from tidemark.sources.versions import Versions
from tidemark.streaming import flows, stateful

_ORDERS = "o AS (SELECT o_orderkey // 400 AS page, row_number() OVER (PARTITION BY o_orderkey // 400 ORDER BY o_orderkey) AS pos, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders)"

#: How a cell of a page tells null from an empty text.
_NULL = "\\N"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in pages of neighbouring keys: (page, cells), the cells of each order."""
    o = table(spark, sf, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 400).alias("page"), "o_orderkey", F.col("o_custkey").cast("string").alias("customer"), "o_orderstatus", "o_orderpriority")


def _cell(c: Column, spans: Column | str = "") -> Column:
    """A cell of HTML with a value's text."""
    text = F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<td"), F.lit(spans), F.lit(">"), F.coalesce(text, F.lit(_NULL)), F.lit("</td>"))


@query(f"WITH {_ORDERS} SELECT page, o_orderkey AS \"order\", o_custkey::VARCHAR AS customer, o_orderpriority AS kind, o_orderstatus AS status FROM o")
def panel_grid(spark, sf):
    """Orders as pages of HTML and back: a head of two rows, a column that spans two, a kind that spans the rows of its page's first three.

    A page lists its orders by kind, so its first three share one that is written once; a kind of fewer spans those it has.
    Null is written as a text of its own.
    """
    listed = F.array_sort(F.collect_list(F.struct("o_orderpriority", "o_orderkey", "customer", "o_orderstatus")))
    o = _lines(spark, sf).groupBy("page").agg(listed.alias("orders"))
    high = F.size(F.filter(F.slice("orders", 1, 3), lambda r: r["o_orderpriority"].eqNullSafe(F.col("orders")[0]["o_orderpriority"])))
    spans = lambda i: F.when(i == 0, F.concat(F.lit(" colspan='2' rowspan='"), "high", F.lit("'"))).otherwise(" colspan='2'")
    kind = lambda r, i: F.when((i > 0) & (i < F.col("high")), "").otherwise(_cell(r["o_orderpriority"], spans(i)))
    tr = F.transform("orders", lambda r, i: F.concat(F.lit("<tr><td>x</td>"), _cell(r["o_orderkey"]), kind(r, i), _cell(r["customer"]), _cell(r["o_orderstatus"]), F.lit("</tr>")))
    head = "<table><tr><td>Order filter</td></tr></table><table><thead><tr><th></th><th>Order</th><th colspan=2>Kind</th><th> Customer </th><th>Status</th></tr><tr><td></td><td><input></td><td>any</td><td>any</td><td></td><td></td></tr></thead><tbody>"
    pages = o.withColumn("high", high).select("page", F.concat(F.lit(head), F.array_join(tr, ""), F.lit("</tbody></table>")).alias("html"))
    cells = grids.grid_maps(grids.grid_lines(pages, "page", "html"), "^Order$").select("page", "cells")
    back = lambda n: F.nullif(F.col(f"cells.{n}"), F.lit(_NULL)).alias(n)
    return cells.select("page", back("order").cast("long").alias("order"), back("customer"), back("kind"), back("status"))


@query(f"WITH {_ORDERS} SELECT page, o_orderkey::VARCHAR AS seller_id, CASE WHEN page % 3 = 2 THEN '' ELSE o_orderpriority END AS plan, CASE WHEN page % 2 = 0 THEN o_custkey::VARCHAR ELSE o_orderstatus END AS email FROM o")
def headers_by_page(spark, sf):
    """Pages whose columns stand elsewhere: odd ones the other way round, every third without the plan, even ones with two that mean e-mail."""
    o = _lines(spark, sf)
    even = F.array(F.col("customer"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    lines = o.select("page", F.when(F.col("page") % 2 == 0, even).otherwise(F.reverse(even)).alias("cells"), F.col("o_orderkey").alias("row_key"))
    plan = F.when(F.col("page") % 3 == 2, "other").otherwise("Plan  Details")
    names = F.when(F.col("page") % 2 == 0, F.array(F.lit("E-Mail Email"), F.lit("Email id"), plan)).otherwise(F.array(plan, F.lit("EMAIL"), F.lit("")))
    heads = o.select("page").distinct().select("page", F.posexplode(names).alias("pos", "header"))
    aliases = {"seller_id": ("seller id",), "email": ("email id", "email"), "plan": ("plan",)}
    return rows.extract_pages(lines, heads, aliases, "row_key").select("page", "seller_id", "plan", "email")


@query("""WITH r AS (SELECT event_id, [event_type || (user_id % 3), 'k' || (event_id % 7)] AS k FROM events), u AS (SELECT event_id, unnest(k) AS key, generate_subscripts(k, 1) AS i FROM r)
 SELECT key, row_number() OVER (ORDER BY min(event_id), arg_min(i, event_id)) - 1 AS pos, count(*) AS rows FROM u GROUP BY key""")
def keys_by_first_sight(spark, sf):
    """Keys of rows of different keys, in the order of a header that unites them, and how many rows have each."""
    e = table(spark, sf, "events")
    cells = e.select("event_id", F.map_from_arrays(F.array(F.concat("event_type", F.col("user_id") % 3), F.concat(F.lit("k"), F.col("event_id") % 7)), F.array(F.lit("1"), F.lit("2"))).alias("cells"))
    wide = grids.united(cells, "cells", F.col("event_id"))
    place = F.create_map(*(x for i, c in enumerate(wide.columns) for x in (F.lit(c), F.lit(i))))
    counts = wide.agg(*(F.count_if(F.col(f"`{c}`") != "").alias(c) for c in wide.columns)).unpivot([], list(wide.columns), "key", "rows")
    return counts.select("key", place[F.col("key")].alias("pos"), "rows")


@query("""WITH s AS (SELECT o_orderkey % 10 < 3 OR o_orderkey % 7 = 0 AS shifted, o_custkey % 9 = 0 AS no_id FROM orders)
 SELECT unnest(['rows', 'kept', 'reject_shifted', 'reject_no_id', 'told_d']) AS name, unnest([count(*), count(*) FILTER (WHERE NOT shifted AND NOT no_id), count(*) FILTER (WHERE shifted), count(*) FILTER (WHERE no_id), count(*) FILTER (WHERE NOT shifted AND NOT no_id)]) AS n FROM s""")
def counts_while_writing(spark, sf):
    """Rows rejected by rule and fields that are told, as the job counts them that writes the rows."""
    k = F.col("o_orderkey") % 10
    o = table(spark, sf, "orders").select(
        F.when(k == 0, "View").when(k == 1, "2024-01-02").when(k == 2, "1/2/24").otherwise("web").alias("p"), F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise("1/2/2024").alias("d"), "o_custkey",
    )
    kept, seen = rows.counted(o, ["d"], {"shifted": rows.shifted(F.col("p"), F.col("d")), "no_id": F.col("o_custkey") % 9 == 0})
    kept.write.mode("overwrite").parquet(f"{shared_folder(spark)}/counts_while_writing")
    return spark.createDataFrame(list(seen.get.items()), "name string, n long")


_PAYLOAD = f"{_ACC}, pay AS (SELECT app AS app_name, seller_id::VARCHAR AS seller_id, plan, CASE WHEN seller_id % 6 = 0 THEN orders || ' or so' ELSE orders::VARCHAR END AS order_count, country, spend FROM acc WHERE seller_id % 4 <> 0)"


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts as JSON arrays of neighbouring ids, with keys that the store does not know, and some objects without an id."""
    a = accounts(spark, sf).where("seller_id % 4 <> 0")
    count = F.when(F.col("seller_id") % 6 == 0, F.concat("orders", F.lit(" or so"))).otherwise(F.col("orders").cast("string"))
    one = F.to_json(F.struct(F.col("app").alias("app_name"), "seller_id", "plan", count.alias("order_count"), F.struct("country").alias("place"), F.lit("x").alias("run_stamp")))
    listed = F.array_join(F.collect_list(one), ",")
    return a.groupBy(F.floor(F.col("seller_id") / 50).alias("doc")).agg(F.concat(F.lit('[{"app_name":"lost"},7,'), listed, F.lit("]")).alias("body"))


@query(f"""WITH {_PAYLOAD}, st AS (SELECT app AS app_name, seller_id::VARCHAR AS seller_id, 'old' AS plan, -1 AS order_count, seller_id % 10 = 1 AS locked FROM acc WHERE seller_id % 3 = 0)
 SELECT coalesce(p.app_name, s.app_name) AS app_name, coalesce(p.seller_id, s.seller_id) AS seller_id, CASE WHEN p.seller_id IS NOT NULL AND NOT coalesce(s.locked, false) THEN p.plan ELSE s.plan END AS plan,
 CASE WHEN p.seller_id IS NOT NULL AND NOT coalesce(s.locked, false) THEN try_cast(p.order_count AS BIGINT) ELSE s.order_count END AS order_count, CASE WHEN p.seller_id IS NOT NULL AND NOT coalesce(s.locked, false) THEN '{{"country":"' || country || '"}}' END AS place,
 CASE WHEN p.seller_id IS NULL THEN 'kept' WHEN s.seller_id IS NULL THEN 'insert' WHEN s.locked THEN 'locked' ELSE 'update' END AS change FROM pay p FULL JOIN st s ON p.app_name = s.app_name AND p.seller_id = s.seller_id""")
def payload_upsert(spark, sf):
    """The guarded upsert of JSON payloads: unknown keys packed, bad integers null, edited rows kept."""
    day = lambda c: F.lit(c).cast("timestamp_ntz")
    stored = accounts(spark, sf).where("seller_id % 3 = 0").select(
        F.col("app").alias("app_name"), F.col("seller_id").cast("string").alias("seller_id"), F.lit("old").alias("plan"), F.lit(-1).cast("long").alias("order_count"), F.lit(None).cast("map<string,string>").alias("extra_fields"),
        F.when(F.col("seller_id") % 10 == 1, day("2024-01-01")).alias("manually_edited_at"), day("2023-01-01").alias("first_seen_at"), day("2024-01-01").alias("last_scraped_at"),
    )
    out = payload.upsert_payload(stored, _payloads(spark, sf), "body", ["app_name", "seller_id"], ["plan", "order_count"], "2024-02-01", ("order_count",))
    return out.select("app_name", "seller_id", "plan", "order_count", F.try_element_at("extra_fields", F.lit("place")).alias("place"), "change")


_TWO_RUNS = f"""{_SNAPS}, one AS (SELECT app, 'sellers' AS kind, seller_id FROM prev UNION ALL SELECT app, 'uninstalls', seller_id FROM prev WHERE seller_id % 5 = 0), two AS (SELECT app, 'sellers' AS kind, seller_id FROM cur WHERE app NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT app, 'uninstalls', seller_id FROM cur WHERE app <> 'BUILDING' AND app <> 'MACHINERY' AND seller_id % 5 = 0)"""


@query(f"""WITH {_TWO_RUNS} SELECT app, kind, 's2' AS run_stamp, seller_id FROM two WHERE NOT (app = 'HOUSEHOLD' AND kind = 'sellers') UNION ALL
 SELECT app, kind, 's1', seller_id FROM one WHERE app = 'MACHINERY' OR (app = 'HOUSEHOLD' AND kind = 'sellers')""")
def latest_after_two_runs(spark, sf):
    """Latest rows after two committed runs: the second reached BUILDING and found nothing, did not reach MACHINERY, and HOUSEHOLD's sellers are blocked."""
    cur, prev = base._pair(spark, sf)
    both = lambda df: df.select("app", F.lit("sellers").alias("kind"), "seller_id").unionByName(df.where("seller_id % 5 = 0").select("app", F.lit("uninstalls").alias("kind"), "seller_id"))
    store_ = Versions(spark, f"{shared_folder(spark)}/latest_after_two_runs")
    apps = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("app")).distinct()
    verdict = apps.where("app = 'HOUSEHOLD'").select("app", F.lit("sellers").alias("kind"), F.lit("blocked").alias("status"))
    runs.commit_run(store_, "s1", both(prev), apps)
    second = both(cur.where(~F.col("app").isin("BUILDING", "MACHINERY")))
    for _ in range(2):  # the second time changes nothing
        runs.commit_run(store_, "s2", second, apps.where("app <> 'MACHINERY'"), apps, verdict)
    return store_.current().read("latest").select("app", "kind", "run_stamp", "seller_id")


@query(f"WITH {_SNAPS} SELECT * FROM cur WHERE app NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT * FROM prev WHERE app = 'MACHINERY'")
def merge_forward_touched(spark, sf):
    """This run reached BUILDING without a row of it, and did not reach MACHINERY."""
    cur, prev = base._pair(spark, sf)
    current = cur.where(~F.col("app").isin("BUILDING", "MACHINERY"))
    return store.merge_forward(current, prev, None, "app", prev.where("app <> 'MACHINERY'").select("app").distinct())


_NULL_ACC = f"{_ACC}, n AS (SELECT CASE WHEN app <> 'BUILDING' THEN app END AS app, installed_d FROM acc)"


@query(f"""WITH {_NULL_ACC}, c AS (SELECT app, date_trunc('year', installed_d) AS y, count(*) AS n FROM n GROUP BY 1, 2), g AS (SELECT DISTINCT app FROM n), s AS (SELECT unnest(generate_series(min(y)::TIMESTAMP, max(y)::TIMESTAMP, INTERVAL 1 YEAR)) AS y FROM c),
 d AS (SELECT g.app, s.y, coalesce(c.n, 0) AS n FROM g CROSS JOIN s LEFT JOIN c ON c.app IS NOT DISTINCT FROM g.app AND c.y = s.y) SELECT app, strftime(y, '%Y') AS period, n FROM d UNION ALL SELECT 'all_apps', strftime(y, '%Y'), sum(n)::BIGINT FROM d GROUP BY y""")
def null_app_series(spark, sf):
    """Installs by year of rows some of which have no app: they are a group, and the totals have them."""
    a = accounts(spark, sf).withColumn("app", F.when(F.col("app") != "BUILDING", F.col("app")))
    return series.fill_gaps(series.period_counts(a, "app", "installed_d", "year"), a, "app", "year")


@query(f"WITH {_SNAPS}, c AS (SELECT CASE WHEN app <> 'BUILDING' THEN app END AS app, seller_id FROM cur), p AS (SELECT CASE WHEN app <> 'BUILDING' THEN app END AS app, seller_id FROM prev), m AS (SELECT coalesce(c.app, p.app) AS app, c.seller_id AS c, p.seller_id AS p FROM c FULL JOIN p ON c.app IS NOT DISTINCT FROM p.app AND c.seller_id = p.seller_id), g AS (SELECT app, count(c) AS \"current\", count(p) AS previous, count(*) FILTER (WHERE p IS NULL) AS new_installs, count(*) FILTER (WHERE c IS NULL) AS churned_sellers, count(*) FILTER (WHERE c IS NOT NULL AND p IS NOT NULL) AS retained_sellers, count(*) FILTER (WHERE p IS NULL AND c % 2 = 0) AS new_uninstalls FROM m GROUP BY 1), t AS (SELECT * FROM g UNION ALL SELECT 'all_apps', sum(\"current\")::BIGINT, sum(previous)::BIGINT, sum(new_installs)::BIGINT, sum(churned_sellers)::BIGINT, sum(retained_sellers)::BIGINT, sum(new_uninstalls)::BIGINT FROM g) SELECT *, new_installs - churned_sellers AS net_growth, coalesce(churned_sellers::DOUBLE / nullif(previous, 0), 0.0) AS churn_rate FROM t")
def null_app_report(spark, sf):
    """The run report where some rows of both logs have no app."""
    cur, prev = (d.withColumn("app", F.when(F.col("app") != "BUILDING", F.col("app"))) for d in base._pair(spark, sf))
    log = [d.where("seller_id % 2 = 0") for d in (cur, prev)]
    return snapshots.run_report(snapshots.delta_counts(cur, prev, "app", ["seller_id"]), snapshots.uninstall_counts(*log, "app", ["seller_id"]), "app")


@query(f"""WITH {_SNAPS}, c AS (SELECT seller_id, plan, CASE WHEN seller_id % 4 <> 0 THEN spend END AS mrr FROM cur), p AS (SELECT seller_id, plan, CASE WHEN seller_id % 3 <> 0 THEN spend END AS mrr FROM prev)
 SELECT coalesce(c.seller_id, p.seller_id) AS seller_id, CASE WHEN p.seller_id IS NULL THEN 'added' WHEN c.seller_id IS NULL THEN 'removed' WHEN c.plan <> p.plan THEN 'plan_changed' ELSE 'same' END AS status, p.plan AS plan_before, c.plan AS plan_after, coalesce(c.mrr, 0) - coalesce(p.mrr, 0) AS mrr_delta FROM c FULL JOIN p ON c.seller_id = p.seller_id""")
def null_amount_diff(spark, sf):
    """A diff of snapshots some of whose rows have no amount: they are there all the same."""
    cur, prev = (d.withColumn("mrr", F.when(F.col("seller_id") % m != 0, F.col("spend"))) for d, m in zip(base._pair(spark, sf), (4, 3), strict=True))
    return snapshots.snapshot_diff(cur, prev, "seller_id")


@query(base._EVENTS + """ SELECT seller_id::VARCHAR AS seller_id, kind FROM ev WHERE kind <> 'failed_order_spike' UNION ALL SELECT seller_id::VARCHAR, 'new_install' FROM cur ANTI JOIN prev USING (seller_id) UNION ALL SELECT seller_id::VARCHAR, 'churned' FROM prev ANTI JOIN cur USING (seller_id)""")
def repeated_key_events(spark, sf):
    """Snapshots that hold each key up to three times, with blanks around it: the last row counts, and events come once."""
    def thrice(df):
        early = df.select(F.col("seller_id").cast("string").alias("seller_id"), F.lit("Early").alias("plan"), (F.col("orders") * 100).alias("orders"), F.lit(0).cast("long").alias("failed"), F.lit(0).alias("pos"))
        last = df.select(F.concat(F.lit(" "), F.col("seller_id").cast("string")).alias("seller_id"), "plan", "orders", F.lit(0).cast("long").alias("failed"), F.lit(2).alias("pos"))
        return early.unionByName(early.where("seller_id % 2 = 0").withColumn("pos", F.lit(1))).unionByName(last)

    cur, prev = base._pair(spark, sf)
    return snapshots.lifecycle_events(thrice(cur), thrice(prev), "seller_id", order=F.col("pos")).select("seller_id", "kind")


@query(f"WITH {_DEP} SELECT pos, lower('User' || seller_id || '@X.com') AS email, 'p ' || platform AS platform, CASE WHEN left_on::TIME >= TIME '00:00:01' THEN strftime(left_on, '%Y-%m-%dT%H:%M:%S') ELSE strftime(left_on, '%Y-%m-%d') END AS uninstalled_on FROM dep")
def normalized_uninstalls(spark, sf):
    """The departure log with odd spaces, capitals and day-first times, made canonical."""
    d = departures(spark, sf).select("pos", F.concat(F.lit(" User"), "seller_id", F.lit("@X.com ")).alias("email"), F.concat(F.lit("p \t"), "platform").alias("platform"), F.date_format("left_on", "dd/MM/yyyy HH:mm:ss").alias("uninstalled_on"))
    return rows.normalize_uninstalls(d)


@query(f"""WITH {_ACC} SELECT seller_id, datediff('day', installed_d, DATE '{AS_OF}') AS days_since_install, datediff('day', installed_d, CASE WHEN seller_id % 4 = 0 THEN last_d ELSE DATE '{AS_OF}' END) AS lifespan_days, datediff('day', last_d, DATE '{AS_OF}') AS days_since_payment, datediff('day', DATE '{AS_OF}', last_d + 365) AS days_to_expiration,
 CASE WHEN orders > 0 THEN failed::DOUBLE / orders ELSE 0.0 END AS failure_rate, CASE WHEN seller_id % 3 = 0 THEN 0 ELSE 2 END AS other_apps, 3 AS plans FROM acc""")
def enriched_subscriptions(spark, sf):
    """Accounts as the panel's text rows, with what is derived from them."""
    a, none = accounts(spark, sf), F.lit("N/A")
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    raw = a.select(
        "seller_id", F.col("plan").alias("current_subscribed_plan"), day("installed_d").alias("installation_date"), F.when(F.col("seller_id") % 4 == 0, day("last_d")).otherwise("(not set)").alias("uninstalltion_date"),
        F.date_format("last_d", "yyyy-MM-dd HH:mm:ss").alias("payment_date"), F.date_format(F.date_add("last_d", 365), "yyyy-MM-dd").alias("expiration_date"), none.alias("last_login_in_app"), F.col("orders").cast("string").alias("total_orders"), F.col("failed").cast("string").alias("failed_orders"),
        F.when(F.col("seller_id") % 3 == 0, "(not set)").otherwise("a, |b").alias("other_oldapps"), F.lit("x|y||z").alias("all_plans_subscribed"), *(none.alias(c) for c in ("success_orders", "total_skus", "published_sku", "staged_sku")),
    )
    e = rows.enrich_subscriptions(raw, AS_OF)
    return e.select("seller_id", F.col("_days_since_install").alias("days_since_install"), F.col("_lifespan_days").alias("lifespan_days"), F.col("_days_since_payment").alias("days_since_payment"), F.col("_days_to_expiration").alias("days_to_expiration"), F.col("_failure_rate").alias("failure_rate"), F.col("_other_oldapps_count").alias("other_apps"), F.col("_plan_history_count").alias("plans"))


@query(f"WITH {_ACC} SELECT 'own' AS app_name, seller_id::VARCHAR AS seller_id, plan, 'country=' || country || CASE WHEN seller_id % 2 = 0 THEN ',steps=' || steps ELSE '' END AS extras FROM acc")
def packed_extra_fields(spark, sf):
    """Columns that the store knows, and the others as a map; the caller's app overrides a row's."""
    a = accounts(spark, sf).select("app", F.col("seller_id").cast("string").alias("seller_id"), "plan", "country", F.when(F.col("seller_id") % 2 == 0, F.col("steps")).alias("steps"), F.lit("row's").alias("app_name")).drop("app")
    packed = rows.packed_extras(a, ["seller_id", "plan"], app_name=F.lit("own"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("extra_fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return packed.select("app_name", "seller_id", "plan", told.alias("extras"))


@query(f"WITH {_ACC} SELECT seller_id, country, plan FROM acc WHERE contains(lower(country || ' ' || plan), 'nation_1') AND app = 'MACHINERY' AND contains(lower(plan), 'pre') AND orders >= 5")
def searched_accounts(spark, sf):
    """The filters of a seller table together: free text, equality, substring and minimum."""
    a = rows.of_app(accounts(spark, sf), "app", "MACHINERY")
    return rows.search_rows(a, " NATION_1 ", ("country", "plan"), {"app": "MACHINERY"}, {"plan": "PRE"}, {"orders": 5}).select("seller_id", "country", "plan")


@query("""WITH m AS (SELECT 'e-' || event_type AS app, min(event_id) AS pos FROM events GROUP BY 1), k AS (SELECT unnest(['e-view', 'e-none']) AS app, unnest([0, 1]) AS pos), a AS (SELECT 'all_apps' AS app, 0 AS part, 0 AS pos UNION ALL SELECT app, 1, pos FROM k UNION ALL SELECT app, 2, pos FROM m WHERE app NOT IN (SELECT app FROM k))
 SELECT app, CAST(row_number() OVER (ORDER BY part, pos, app) AS INT) AS rank FROM a""")
def apps_in_order(spark, sf):
    met = table(spark, sf, "events").select(F.concat(F.lit("e-"), "event_type").alias("app"), F.col("event_id").alias("pos"))
    known = runs.registry(spark, [{"app": "e-view"}, {"app": "e-none"}])
    return rows.apps_in_order(met, known, "app", "pos")


@query("""WITH c AS (SELECT DISTINCT c_mktsegment AS app FROM customer), r AS (SELECT app FROM c WHERE app < 'HOUSE' AND app <> 'BUILDING'), n AS (SELECT c_mktsegment AS app, count(*) FILTER (WHERE c_mktsegment <> 'AUTOMOBILE') AS n FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1)
 SELECT r.app, coalesce(n, 0) AS rows, CASE WHEN n IS NULL THEN 'stale' WHEN n = 0 THEN 'empty' ELSE 'ok' END AS health FROM r LEFT JOIN n USING (app)""")
def ready_app_health(spark, sf):
    """Apps that may run, and whether the last run found rows of them."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("app"))
    known = c.distinct().select("app", F.when(F.col("app") < "HOUSE", "canonical").otherwise("pending_review").alias("status"), F.lit(True).alias("has_credentials"), F.when(F.col("app") == "BUILDING", True).alias("blocked"))
    ran = c.where("app <> 'FURNITURE'").groupBy("app").agg(F.count_if(F.col("app") != "AUTOMOBILE").alias("n"))
    return rows.scrape_health(rows.ready_apps(known), ran, "app")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'X11; Linux ' || user_id || ' · Chrome/' || event_id WHEN 1 THEN 'Firefox/9' WHEN 2 THEN 'curl ' || user_id ELSE '—' END AS agent, CASE WHEN event_id % 2 = 0 THEN event_type || ':' || user_id ELSE user_id::VARCHAR END AS target, 'k=' || json_extract_string(props, '$.k') || ' · t=' || event_type AS details FROM events")
def audit_texts(spark, sf):
    """What an activity list shows: agent, target and details in short."""
    k = F.col("event_id") % 4
    agent = F.when(k == 0, F.concat(F.lit("Mozilla/5.0 (X11; Linux "), "user_id", F.lit(") AppleWebKit Chrome/"), "event_id", F.lit(" Safari/5"))).when(k == 1, "Firefox/9/").when(k == 2, F.concat(F.lit("curl "), "user_id"))
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("t"), F.col("event_type"), F.lit("u"), F.lit("")))
    return table(spark, sf, "events").select("event_id", text.short_agent(agent).alias("agent"), text.target_text(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.col("user_id")).alias("target"), text.details_text(props).alias("details"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS panel, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS seller, CASE WHEN o_orderkey % 4 IN (0) THEN CAST(o_orderdate AS DATE) END AS iso FROM orders""")
def date_dialects(spark, sf):
    """The dates of orders in four spellings, as each dialect reads them."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    told = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.concat(F.lit("  "), F.date_format(d, "yyyy-M-d"), F.lit(" 00:00:00"))).otherwise("0000-00-00")
    told = F.when(k == 2, F.concat(F.lit(" "), F.date_format(d, "d/M/yyyy"))).otherwise(told)
    odd = F.when(k == 2, F.lit("soon")).otherwise(told)
    return table(spark, sf, "orders").select("o_orderkey", dates.panel_date(told).alias("panel"), dates.seller_date(odd).alias("seller"), dates.iso_date(F.when(k == 1, told).otherwise(odd)).alias("iso"))


@query("""WITH v AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_custkey AS n FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN n WHEN 1 THEN n * 1000 ELSE 0 END AS coerced, CASE k WHEN 0 THEN n WHEN 1 THEN n * 1000 WHEN 2 THEN n ELSE 0 END AS truncated, CASE k WHEN 0 THEN n ELSE 0 END AS plain, CASE k WHEN 0 THEN n END AS nullable FROM v""")
def number_dialects(spark, sf):
    """Numbers as they are, with separators, with fractions, blank and as other text, in each dialect."""
    k, n = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    told = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(",000"))).when(k == 2, F.concat(n, F.lit(".75"))).when(k == 3, "  ").otherwise("n/a")
    return table(spark, sf, "orders").select("o_orderkey", numbers.coerce_int(told).alias("coerced"), numbers.truncated_int(told).alias("truncated"), numbers.plain_int(told).alias("plain"), numbers.nullable_int(told).alias("nullable"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '/+$', '') AS loose, CASE page_id % 3 WHEN 0 THEN 'First' ELSE 'p' || page_id % 3 END AS name, page_id % 4 <> 1 AS equal FROM pages")
def loose_keys(spark, sf):
    """Keys for fallback joins, display names, and cells that count as equal."""
    p, k = table(spark, sf, "pages"), F.col("page_id") % 4
    other = F.when(k == 0, F.concat(F.lit(" "), F.col("url"), F.lit(" "))).when(k == 1, F.concat("url", F.lit("x"))).otherwise(F.col("url"))
    blank = F.when(k == 2, F.lit("NaN")).when(k == 3, F.lit(" ")).otherwise(F.col("url"))
    return p.select("page_id", text.loose_url(F.col("url")).alias("loose"), text.display_name(F.concat(F.lit("p"), F.col("page_id") % 3), {"p0": "First"}).alias("name"), store.cell_equal(blank, F.when(k >= 2, F.lit(None).cast("string")).otherwise(other)).alias("equal"))


@query(f"WITH {_ACC} SELECT app AS app_name, seller_id::VARCHAR AS seller_id, orders AS last_scraped_at FROM acc WHERE app = 'MACHINERY' AND seller_id % 3 = 0 ORDER BY orders DESC, seller_id::VARCHAR LIMIT 25")
def looked_up_edits(spark, sf):
    """Edited rows of one app from a table that is sorted and filtered for lookups."""
    a = accounts(spark, sf).select(F.col("app").alias("app_name"), F.col("seller_id").cast("string").alias("seller_id"), F.when(F.col("seller_id") % 3 == 0, F.col("last_d")).alias("manually_edited_at"), F.col("orders").alias("last_scraped_at"))
    path = f"{shared_folder(spark)}/looked_up_edits"
    store.write_lookup(a, path, ["app_name", "seller_id"])
    found = store.matching(spark, path, app_name="MACHINERY").where("manually_edited_at is not null")
    return found.orderBy(F.desc("last_scraped_at"), "seller_id").limit(25).drop("manually_edited_at")


@query("SELECT event_id, user_id, event_type, ts AS edited_at FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 200")
def latest_edits(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("edited_at"))
    return store.edit_log(e, {"event_type": "purchase"})


@query(f"WITH {_SNAPS}, r AS (SELECT 's2-' || seller_id // 100 AS run_stamp, app, seller_id, plan, orders FROM cur UNION ALL SELECT 's1-' || seller_id // 100, app, seller_id, plan, orders FROM prev) SELECT run_stamp, app, row_number() OVER (PARTITION BY run_stamp, app ORDER BY seller_id) - 1 AS pos, seller_id::VARCHAR AS seller_id, plan, orders::VARCHAR AS order_count FROM r")
def run_files(spark, sf):
    """Run files of neighbouring ids, written and read back: rows by app in their order, fields as text, keys that nobody knows left out."""
    cur, prev = base._pair(spark, sf)
    both = cur.withColumn("run", F.lit("s2-")).unionByName(prev.withColumn("run", F.lit("s1-"))).withColumn("run_stamp", F.concat("run", F.floor(F.col("seller_id") / 100)))
    row = F.struct("seller_id", "plan", F.col("orders").cast("string").alias("order_count"), F.lit(1).alias("later"))
    apps = both.groupBy("run_stamp", "app").agg(F.transform(F.array_sort(F.collect_list(F.struct("seller_id", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    docs = apps.groupBy("run_stamp").agg(F.map_from_entries(F.collect_list(F.struct("app", "rows"))).alias("data"))
    path = f"{shared_folder(spark)}/run_files"
    docs.repartition(8, "run_stamp").select(F.to_json(F.struct("run_stamp", "data")).alias("value")).write.text(path)
    # a document a line here, as these files are many runs each
    found = runs.seller_rows(spark.read.schema(runs.RUN_SCHEMA).json(path))
    return found.select("run_stamp", "app", F.col("pos").cast("long").alias("pos"), "seller_id", "plan", "order_count")


@query(f"WITH {_ACC} SELECT seller_id::VARCHAR AS seller_id, 'say \"' || plan || '\",' || chr(10) || country AS plan, coalesce(CASE WHEN seller_id % 2 = 0 THEN app END, '') AS app, '' AS email FROM acc")
def csv_export(spark, sf):
    """Accounts as CSV of fixed columns and back: quotes and line breaks stay, missing cells and columns are blank, others are left out."""
    a = accounts(spark, sf).select("seller_id", F.concat(F.lit('say "'), "plan", F.lit('",\n'), "country").alias("plan"), F.when(F.col("seller_id") % 2 == 0, F.col("app")).alias("app"), "orders")
    fields, path = ("seller_id", "plan", "app", "email"), f"{shared_folder(spark)}/csv_export"
    runs.write_csv(a, path, fields)
    return runs.read_csv(spark, path, fields).select(*(F.coalesce(c, F.lit("")).alias(c) for c in fields))


@query(f"WITH {_SNAPS} SELECT 'before' AS side, app, count(*) AS rows FROM prev GROUP BY 2 UNION ALL SELECT 'now', app, count(*) FROM cur GROUP BY 2")
def stored_pair(spark, sf):
    """The two latest of three stored runs, where an empty source comes first in the chain and the last run was stored twice."""
    cur, prev = base._pair(spark, sf)
    folder = f"{shared_folder(spark)}/stored_pair"
    for df, stamp in ((cur.where("false"), "s0"), (prev, "s1"), (cur, "s2"), (cur, "s2")):
        runs.rotate(df, folder, stamp)
    before, now = runs.first_full_pair(lambda: None, lambda: (cur.where("false"), cur), lambda: runs.pair_of_history(spark, folder))
    return before.withColumn("side", F.lit("before")).unionByName(now.withColumn("side", F.lit("now"))).groupBy("side", "app").agg(F.count("*").alias("rows"))


def _events(spark: SparkSession, sf: str, at_once: int | None = 64) -> DataFrame:
    """The events as a stream of files; the pattern fits a table of one file as well as a folder of them.

    Files are in no order of time, so behind a watermark all that is there has to be one batch
    (``at_once`` None): rows of a later one would be late.
    """
    of = table(spark, sf, "events").schema
    reader = spark.readStream.schema(of)
    stream = (reader.option("maxFilesPerTrigger", at_once) if at_once else reader).parquet(f"{sf}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _rows_of_stream(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stateful stream puts out of all that is there, as stored batches."""
    folder, key = shared_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    store_, was = Versions(spark, f"{folder}/out"), spark.conf.get(key)
    spark.conf.set(key, stateful.PROVIDER)
    try:
        flows.on_snapshots(stream, lambda df, n: store_.commit(str(n), append={"rows": df}), f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(key, was)
    return store_.current().read("rows")


_SETTLED = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events WHERE epoch_us(ts) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 7200000 FROM events))"


@query(f"WITH {_SETTLED} SELECT event_id, user_id, event_type FROM e QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def streamed_page_changes(spark, sf):
    """Changes of page of the events that a watermark of two hours has passed, by keyed state."""
    return _rows_of_stream(spark, stateful.page_changes(_events(spark, sf, None), "ts", ["user_id"], "event_type", ["event_id"], forget=10**8)).select("event_id", "user_id", "event_type")


@query(f"""WITH RECURSIVE {_SETTLED}, g(user_id, ms) AS (SELECT user_id, min(ms) FROM e GROUP BY 1 UNION ALL SELECT g.user_id, (SELECT min(e.ms) FROM e WHERE e.user_id = g.user_id AND e.ms >= g.ms + 86400000) FROM g WHERE g.ms IS NOT NULL)
 SELECT user_id, ms FROM g WHERE ms IS NOT NULL""")
def streamed_beats(spark, sf):
    """At most one event a user in a day since the last that went on, by keyed state."""
    rows_ = _rows_of_stream(spark, stateful.throttled(_events(spark, sf, None), "ts", ["user_id"], ["event_id"], seconds=86400))
    return rows_.select("user_id", F.unix_millis("ts").alias("ms"))


@query("SELECT event_type AS app, CAST(date_trunc('month', ts) AS DATE) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_installs(spark, sf):
    """Counts by app and month that a stream keeps in a store, by periods."""
    folder = shared_folder(spark)
    store_ = Versions(spark, f"{folder}/series")
    counts = flows.install_counts(_events(spark, sf).withColumn("app", F.col("event_type")), "ts")
    flows.to_sink(counts, flows.install_sink(store_), f"{folder}/checkpoint").awaitTermination()
    return store_.current().read("installs")


_LARGE = f"{_ACC}, {base._PROD}, x AS (SELECT seller_id, {base._IS_PAID} AS paid, orders * 20 AS orders, products * 20 AS products FROM prod)"


@query(f"""WITH {_LARGE}, l AS (SELECT 'heavy_catalogue' AS rule, seller_id, products AS amount FROM x WHERE NOT paid AND products >= 500 UNION ALL SELECT 'upsell', seller_id, orders FROM x WHERE paid AND orders >= 200)
 SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY rule ORDER BY amount DESC, seller_id) <= 50""")
def leads_of_large_accounts(spark, sf):
    """The two lead lists that want large figures, of accounts twenty times as large as the table's."""
    a = base._fit(spark, sf).withColumns({"steps": F.lit(0), "orders": F.col("orders") * 20, "products": F.col("products") * 20})
    ruled = a.join(segments.lead_rules(a), "seller_id")
    lists = [leads.ordered_list(ruled, rule, "seller_id", 50).select("rule", "seller_id", F.col(by).alias("amount")) for rule, by in (("heavy_catalogue", "products"), ("upsell", "orders"))]
    return lists[0].unionByName(lists[1])


@query(f"WITH {_DEP} SELECT seller_id, min(pos) AS pos FROM dep WHERE seller_id NOT IN (SELECT seller_id FROM dep WHERE left_on < TIMESTAMP '2024-01-03') GROUP BY 1")
def uninstalls_since(spark, sf):
    """The first entry of each seller that an early log lacks."""
    d = departures(spark, sf)
    return snapshots.new_uninstalls(d, d.where("left_on < timestamp_ntz '2024-01-03'"), "seller_id", F.col("pos")).select("seller_id", "pos")
