"""Small cases of gates, rows, sources, reports and streams that the queries do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import gates, leads, profiles, rows, series, snapshots, store
from tidemark.plans import reports
from tidemark.sources import runs
from tidemark.streaming import flows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_composite_keys_keep_blank_parts_and_the_last_row(spark):
    kind = "pos int, seller_id string, platform string, day string"
    now = spark.createDataFrame([(1, "a", "web", "d"), (2, "a", "web", "d"), (3, "a", None, "d"), (4, None, None, None), (5, "b", "web", "d")], kind)
    before = spark.createDataFrame([(1, "b", "web", "d")], kind)
    keys = ["seller_id", "platform", "day"]
    got = sorted((r.pos, r.platform) for r in snapshots.new_composite(now, before, keys, F.col("pos")).collect())
    assert got == [(2, "web"), (3, ""), (4, "")]
    counts = snapshots.uninstall_counts(now.withColumn("app", F.lit("x")), before.withColumn("app", F.lit("x")), "app", keys).first()
    assert (counts.current, counts.previous, counts.new_uninstalls) == (4, 1, 3)
    last = snapshots.last_rows(now, ["seller_id"], F.col("pos")).collect()
    assert sorted((r.seller_id, r.pos) for r in last) == [("a", 3), ("b", 5)]


def test_events_of_both_snapshots(spark):
    kind = "id string, plan string, orders long, failed long"
    prev = spark.createDataFrame([("a", "Free", 1, 0), (" b ", "Pro", 9, 0), ("c", "Pro", 1, 0), (" ", "Pro", 1, 0)], kind)
    cur = spark.createDataFrame([("a", "Pro", 9, 5), ("d", "Lite", 0, 0), ("", "Pro", 1, 0)], kind)
    found = lambda log: sorted((r.id, r.kind) for r in snapshots.lifecycle_events(cur, prev, "id", log).collect())
    shared = [("a", "failed_order_spike"), ("a", "order_spike"), ("a", "plan_upgrade")]
    assert found(None) == sorted([*shared, ("b", "churned"), ("c", "churned"), ("d", "new_install")])
    assert found(prev.where("id = 'c'").select("id")) == sorted([*shared, ("c", "churned"), ("d", "new_install")])
    assert found(prev.where("false").select("id")) == sorted([*shared, ("d", "new_install")])


def test_gates_and_promotion(spark):
    status = spark.createDataFrame([("a", "sellers", "ok"), ("a", "uninstalls", "blocked"), ("b", "sellers", "pending_review")], "app string, kind string, status string")
    worse = spark.createDataFrame([("b", "sellers", "ok"), ("a", "sellers", "pending_review")], "app string, kind string, status string")
    v = gates.verdicts({"x": status, "y": worse}, ["app", "kind"])
    assert {(r.app, r.kind): (r.status, r.failed) for r in v.collect()} == {("a", "sellers"): ("pending_review", ["y"]), ("a", "uninstalls"): ("blocked", ["x"]), ("b", "sellers"): ("pending_review", ["x"])}
    kind = "app string, kind string, id int"
    now = spark.createDataFrame([("a", "sellers", 2), ("a", "uninstalls", 2), ("b", "sellers", 2)], kind)
    was = spark.createDataFrame([("a", "sellers", 1), ("a", "uninstalls", 1), ("c", "sellers", 1)], kind)
    latest, staged = gates.promoted(now, was, v, ["app", "kind"])
    assert sorted(map(tuple, latest.collect())) == [("a", "sellers", 2), ("a", "uninstalls", 1), ("b", "sellers", 2), ("c", "sellers", 1)]
    assert [tuple(r) for r in staged.collect()] == [("a", "uninstalls", 2)]
    md = reports.validation_markdown(v, "s")
    assert "Status: blocked" in md and "- a / uninstalls: blocked (x)" in md and "1 of 3 keep" in md


@pytest.mark.parametrize(("pages", "want"), [
    ([(1, 1, "a", 10, 20), (2, 2, "b", 10, 20)], "ok"), ([(1, 1, "a", 10, 20), (2, 3, "b", 10, 20)], "blocked"), ([(1, 1, "a", 10, 20), (2, 2, "a", 10, 20)], "blocked"),
    ([(1, 1, "a", 0, None), (2, 2, "b", 10, None)], "blocked"), ([(1, 1, "a", 10, None), (2, 2, "", 0, None)], "ok"), ([(1, 1, "a", 10, 12)], "blocked"), ([(1, 1, None, 0, 0)], "ok"),
])
def test_pagination(spark, pages, want):
    t = spark.createDataFrame([("g", *p) for p in pages], "g string, pos int, page_num int, first_key string, rows int, reported int")
    assert gates.pagination_check(t, "g").first().status == want


def test_extraction(spark):
    names = {"seller_id": ("seller id",), "email": ("email id", "email"), "store_url": ("store url",), "plan": ("plan",)}
    assert rows.resolve_headers(["Plan  Details", "E-mail", "User Email ID", "SELLER ID "], names) == {"seller_id": "SELLER ID ", "email": "User Email ID", "plan": "Plan  Details"}
    grid = spark.createDataFrame([("", " a  b ", "x.com//", "k1"), ("7", None, None, "k2")], "`Seller Id` string, Email string, `Store URL` string, row_key string")
    assert [tuple(r) for r in rows.extract_rows(grid, names, "row_key").collect()] == [("k1", "a b", "x.com", ""), ("7", "", "", "")]
    bad = spark.createDataFrame([("View", "1/2/2026"), ("2026-02-18", ""), ("1-2-26", ""), ("web", "soon"), ("web", "1/2"), (None, None)], "p string, d string")
    assert [r[0] for r in bad.select(rows.shifted(F.col("p"), F.col("d"))).collect()] == [True, True, True, True, False, False]
    cell = spark.createDataFrame([(1, "Shopify 2026-02-18 20:13:03 My Shop/x 2026-02-18 20:14:07"), (2, "?"), (3, None)], "id int, shops_raw string")
    assert [(r.id, r.platform, r.uninstalled_on) for r in rows.explode_shops(cell).collect()] == [(1, "Shopify", "2026-02-18 20:13:03"), (1, "My Shop/x", "2026-02-18 20:14:07"), (2, "", ""), (3, "", "")]


def test_rows(spark):
    df = spark.createDataFrame([(" a b ", "X@Y.z ", "03/04/2026 10:00:00")], "username string, email string, uninstalled_on string")
    assert tuple(rows.normalize_uninstalls(df).first()) == ("a b", "x@y.z", "2026-04-03T10:00:00")
    raw = spark.createDataFrame([("Lite $30 Monthly", "2026-01-01", "(not set)", "2026-01-11", "2026-05-01", "n/a", "10", "3", "x", "a, b|,c", "Free|Lite")], "current_subscribed_plan string, installation_date string, uninstalltion_date string, payment_date string, expiration_date string, last_login_in_app string, total_orders string, failed_orders string, published_sku string, other_oldapps string, all_plans_subscribed string")
    raw = raw.withColumns({c: F.lit("1,000") for c in ("success_orders", "total_skus", "staged_sku")})
    r = rows.enrich_subscriptions(raw, "2026-04-01").first()
    assert (r._mrr_usd, r._lifespan_days, r._days_to_expiration, r._days_to_first_payment, r._days_since_login) == (30.0, 90, 30, 10, None)
    assert (r._total_orders_n, r._published_sku_n, r._total_skus_n, r._failure_rate, r._other_oldapps_count, r._plan_history_count) == (10, 0, 0, 0.3, 3, 2)
    assert not [c for c in rows.without_derived(rows.enrich_subscriptions(raw, "2026-04-01")).columns if c.startswith("_")]
    packed = rows.packed_extras(spark.createDataFrame([("1", "e", None, "z")], "seller_id string, email string, x string, app_name string"), ["seller_id", "email"], app_name=F.lit("own")).first()
    assert (packed.app_name, packed.seller_id, packed.extra_fields) == ("own", "1", {})
    found = rows.search_rows(spark.createDataFrame([("A@b", "Shop", "IN", 5), ("c", None, "US", 9)], "email string, shop string, country string, orders int"), "SHOP", ("email", "shop"), {"country": "IN"}, {"country": "i"}, {"orders": 3})
    assert [r.email for r in found.collect()] == ["A@b"]
    reg = spark.createDataFrame([("z", 0), ("m", 1)], "app string, pos long")
    met = spark.createDataFrame([("q", 5), ("m", 1), ("b", 7)], "app string, pos long")
    assert [r.app for r in rows.apps_in_order(met, reg, "app", "pos").orderBy("rank").collect()] == ["all_apps", "z", "m", "q", "b"]
    active, ran = spark.createDataFrame([("a",), ("b",), ("c",)], "app string"), spark.createDataFrame([("a", 3), ("b", 0)], "app string, n long")
    assert {r.app: r.health for r in rows.scrape_health(active, ran, "app").collect()} == {"a": "ok", "b": "empty", "c": "stale"}
    assert rows.with_empty_apps(ran, active, "app", ["n"]).where("app = 'c'").first().n == 0
    config = runs.registry(spark, [{"app": "a", "status": "canonical", "has_credentials": True, "later": 1}, {"app": "b", "status": "canonical", "has_credentials": True, "blocked": True}])
    assert [r.app for r in rows.ready_apps(config).collect()] == ["a"]


def test_texts(spark):
    agent = "Mozilla/5.0 (X11; Linux) AppleWebKit (like) Chrome/99.1 Safari/5"
    assert one(spark, agent, text.short_agent) == "X11; Linux · Chrome/99.1" and one(spark, None, text.short_agent) == "—" and one(spark, "curl", text.short_agent) == "curl"
    assert one(spark, {"a": "x" * 41, "b": "", "c": "1"}, text.details_text, "map<string,string>") == f"a={'x' * 37}… · c=1"
    assert one(spark, "7", lambda c: text.target_text(F.lit("seller"), c)) == "seller:7" and one(spark, None, lambda c: text.target_text(c, c)) == "—"
    assert one(spark, "x", lambda c: text.display_name(c, {"x": "X app"})) == "X app" and one(spark, "y", lambda c: text.display_name(c, {"x": "X app"})) == "y"
    assert str(one(spark, "3/4/2026", dates.install_date)) == "2026-04-03" and str(one(spark, "2026-04-03 x", dates.seller_date)) == "2026-04-03"
    assert one(spark, "junk", dates.parse_run_stamp) is None and one(spark, "bad", dates.day_label) == "bad"
    assert [one(spark, x, lambda c: store.cell_equal(c, F.lit(" "))) for x in (None, "NaN", "a")] == [True, True, False]
    assert store.frameworks(" A, ,b,a") == ["a", "b"] and store.frameworks("") == ["auto"] and store.promote_schema(["x", "a", "x"], ["a"], ["o"]) == ["o", "x"]


def test_sources(spark, tmp_path):
    run = lambda path, stamp: (path.mkdir(parents=True), (path / "run.json").write_text(json.dumps({"run_stamp": stamp, "data": {"a": [{"seller_id": "1"}]}})))
    history, latest = tmp_path / "history", tmp_path / "latest"
    assert runs.latest_run(spark, str(history), str(latest)) == (None, None)
    run(latest, "l")
    assert runs.latest_run(spark, str(history), str(latest))[0] == "__latest__"
    run(history / "2026-01-01", "1")
    run(history / "2026-01-02", "2")
    stamp, found = runs.latest_run(spark, str(history), str(latest))
    assert stamp == "2026-01-02" and runs.seller_rows(found).first().run_stamp == "2"
    assert runs.read_optional_csv(spark, str(tmp_path / "none.csv"), ("a", "b")).collect() == []
    folder = str(tmp_path / "snaps")
    assert runs.pair_of_history(spark, folder) is None
    df = spark.createDataFrame([("a", "1")], "app string, seller_id string")
    runs.rotate(df, folder, "s1")
    before, now = runs.pair_of_history(spark, folder)
    assert (before.count(), now.count()) == (0, 1)
    runs.rotate(df.union(df), folder, "s2")
    before, now = runs.pair_of_history(spark, folder)
    assert (before.count(), now.count()) == (1, 2)
    chosen = runs.first_full_pair(lambda: None, lambda: (df.where("false"), df), lambda: (before, now), lambda: 1 / 0)
    assert chosen[1].count() == 2
    two = runs.union_rows([spark.createDataFrame([(1, 2)], "b int, a int"), spark.createDataFrame([(3, 4)], "a int, c int")])
    assert two.columns == ["b", "a", "c"] and sorted(map(tuple, two.collect()), key=str) == [(1, 2, None), (None, 3, 4)]
    runs.persist_run(df, df.where("false"), str(tmp_path / "run"), "s3")
    assert spark.read.parquet(str(tmp_path / "run" / "latest")).first().run_stamp == "s3"
    runs.append_alerts(df.withColumn("run_stamp", F.lit("s")), str(tmp_path / "alerts"), "2026-01-01 00:00:00")
    assert str(spark.read.parquet(str(tmp_path / "alerts")).first().created_at) == "2026-01-01 00:00:00"
    page = "<table><tr><th>A b</th><th>C</th></tr><tr><td>1<table><tr><td>x</td></tr></table></td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    grid = runs.html_grid(spark.createDataFrame([(page,), (None,)], "html string"), "html", ("a_b", "c"))
    assert [tuple(r) for r in grid.collect()] == [("1", "2"), ("3", "4")]


def test_stakeholder_report(spark):
    sellers = spark.createDataFrame([
        ("a", "1", "2026-01-05", "Pro", "2/4", "IN", "web", 5, 1, 7, "x@y.z"), ("a", "2", "2026-03-05", "Free", None, "IN", "web", 0, 0, 0, "q@own.test"), ("b", "3", "2026-03-09", "N/A", "", None, None, 0, 0, 3, None), ("b", "4", None, "Pro", "1", "US", "app", 2, 0, 0, ""),
    ], "app string, seller_id string, d string, plan string, steps string, country string, platforms string, orders long, failed long, products long, email string").withColumn("installed_d", F.to_date("d"))
    gone = spark.createDataFrame([("a", "9", "web", "2026-02-01 10:00:00"), ("a", "9", "app", "2026-02-02 10:00:00"), ("a", "8", "", "2026-04-02 10:00:00")], "app string, seller_id string, platform string, t string").withColumn("left_on", F.to_timestamp_ntz("t"))
    report = reports.stakeholder_report(sellers, gone, "2026-04-01", domains=("own.test",))
    month = {(r.app, r.period): (r.installs, r.uninstalls) for r in report["month"].collect()}
    assert month[("all_apps", "2026-01")] == (1, 0) and month[("a", "2026-02")] == (0, 1) and month[("all_apps", "2026-03")] == (1, 0) and month[("b", "2026-04")] == (0, 0)
    assert {r.app: r.coverage_pct for r in report["steps_coverage"].collect()} == {"a": 100.0, "b": 0.0, "all_apps": pytest.approx(100 / 3)}
    assert {r.platform: r.n for r in report["uninstall_platforms"].where("app = 'all_apps'").collect()} == {"web": 1, "app": 1, "(empty)": 1}
    md = reports.stakeholder_markdown(report, "2026-04-01_10-00-00Z")
    assert "# Report of 1 Apr 2026" in md and "| all_apps | 2 | 0 | 1 | 3 |" in md and "| Jan 2026 | 1 |" in md and "| IN | 1 |" in md
    assert reports.stakeholder_report(sellers, gone, "2026-04-01", exclude=False)["paid"].where("app = 'all_apps'").first().total == 4


def test_snapshots_arrive(spark, tmp_path):
    arrivals, history, metrics = (str(tmp_path / x) for x in ("in", "history", "metrics"))
    kind = "app string, run_stamp string, seller_id string, plan string"
    handler = flows.snapshot_handler(history, metrics, ["seller_id"])
    for stamp, ids in (("s1", "12"), ("s2", "234"), ("s2", "9")):
        spark.createDataFrame([("a", stamp, i, "Pro") for i in ids], kind).coalesce(1).write.mode("append").parquet(arrivals)
        stream = flows.event_stream(spark, arrivals, kind)
        flows.on_snapshots(stream, handler, str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r.run_stamp, r.metric_name): r.value for r in spark.read.parquet(metrics).where("app is null").collect()}
    assert (got["s1", "new"], got["s2", "new"], got["s2", "churned"], got["s2", "current"]) == (2, 2, 1, 3)


def test_rolling_stream_counts_as_the_batch_does(spark, tmp_path):
    days = [(f"2026-01-{d:02d} 12:00:00",) for d in (1, 2, 2, 9)]
    df = spark.createDataFrame(days, "t string").select(F.to_timestamp("t").alias("ts"), F.lit("g").alias("g"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.shifted_rolling_counts(flows.event_stream(spark, str(tmp_path / "in"), "ts timestamp, g string"), "ts", days=3)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = {str(r.day): r.n for r in spark.table("rolled").collect()}
    want = {str(r.day): r.n for r in series.rolling(df, "g", "ts", "2026-01-11", days=3, lookback=11).collect() if r.n}
    assert got == want


def test_profiles_are_made_once(spark):
    df = spark.createDataFrame([("a", "1", "shoes"), ("a", "2", None), ("a", "3", "hats")], "app_name string, seller_id string, text string")
    kind = "app_name string, seller_id string, business_type string, categories array<string>, insight string, source string, cached_at string"
    cache = spark.createDataFrame([("a", "1", "old", [], "", "model", "2026-03-20"), ("a", "3", "old", [], "", "model", "2026-01-01")], kind).withColumn("cached_at", F.col("cached_at").cast("timestamp_ntz"))

    def classify(texts):
        return profiles.unknown(texts).assign(insight=texts.str.upper())

    got = {r.seller_id: (r.business_type, r.insight) for r in profiles.enriched(df, cache, ["app_name", "seller_id"], "text", "2026-04-01", classify).collect()}
    assert got == {"1": ("old", ""), "2": ("Unknown", ""), "3": ("Unknown", "HATS")}
    broken = profiles.classified(df, ["seller_id"], "text", lambda texts: 1 / 0)
    assert {r.source for r in broken.collect()} == {"error"}
    rep = leads.rep_table(rows.with_insight(df.withColumns({c: F.lit(None).cast("string") for c in ("plan", "installed_on", "order_count", "product_count", "failed_order_count", "steps_completed")}), "2026-04-01"), ("seller_id", "city"))
    assert tuple(rep.where("seller_id = '1'").first()) == ("Low", 0, "1", "", "—")
    assert rows.of_app(df, "app_name", "all_apps").count() == 3 and rows.of_app(df, "app_name", "b").count() == 0
