"""Small cases of the functions, operators, sources and streams."""

import json

from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, scores, text
from tidemark.operators import revenue, segments, series, snapshots, store
from tidemark.plans import reports
from tidemark.sources import runs
from tidemark.streaming import flows


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_text(spark):
    assert column(spark, ["  a \t b\n c ", None, ""], text.normalize_whitespace) == ["a b c", "", ""]
    assert column(spark, ["HTTPS://Www.Example.COM/Path/", "http://a.b//", " "], text.store_url) == ["example.com/Path", "a.b/", ""]
    assert column(spark, ["shopdemo", "shop-test", "development", "qatar"], text.is_test_name) == [True, True, False, False]
    assert column(spark, ["<style>x</style><p>a</p>\n<b>c</b>", None], text.html_to_text) == ["a c", ""]


def test_long_pages_are_whole(spark, tmp_path):
    from tidemark.plans.queries import QUERIES

    head = "<html><head><title> A b </title><META name='description' x content='\n c d '><script>no</script></head>"
    rows = [(1, f"{head}<p>{'word ' * 4000}</p>end"), (2, "<p>x</p>"), (3, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.title, r.description, r.body) for r in QUERIES["html_text"](spark, str(tmp_path)).collect()}
    assert got == {1: ("A b", "c d", "A b " + "word " * 4000 + "end"), 2: ("", "", "x"), 3: ("", "", "")}
    assert column(spark, ["<p>abc</p>"], lambda c: text.html_to_text(c, 2)) == ["ab"]


def test_dates(spark):
    got = column(spark, ["03/04/2026", "03/04/2026 14:30:00", "2026-04-18 00:00:00", "03-04-2026", " junk ", "2026-04-18T10:00:00Z", None], dates.normalize_date)
    assert got == ["2026-04-03", "2026-04-03T14:30:00", "2026-04-18", "2026-04-03", "junk", "2026-04-18T10:00:00", None]
    assert [str(x) for x in column(spark, ["2026-04-18T10:00", "03/04/2026", "2026-4-1"], dates.iso_date)] == ["2026-04-18", "None", "2026-04-01"]
    assert column(spark, ["2026-Q2", "x"], lambda c: dates.period_label(c, "quarter")) == ["Q2 2026", "x"]


def test_numbers(spark):
    values = ["1,234", "", None, "800.0", "N/A", "7"]
    assert column(spark, values, numbers.coerce_int) == [1234, 0, 0, 0, 0, 7]
    assert column(spark, values, numbers.truncated_int) == [1234, 0, 0, 800, 0, 7]
    assert column(spark, values, numbers.plain_int) == [0, 0, 0, 0, 0, 7]
    assert column(spark, values, numbers.nullable_int) == [None, None, None, None, None, 7]


def test_plans_and_scores(spark):
    got = column(spark, ["Lite $30 Monthly", "Yearly", "(not set)", "Pro $1,200 Yearly"], lambda c: scores.parse_plan(c, {"yearly": 16.67}))
    assert [tuple(x) for x in got] == [("Lite", 1, 30.0, 30.0), ("Yearly", 12, None, 16.67), ("", 0, None, 0.0), ("Pro", 12, 1200.0, 100.0)]
    rows = spark.createDataFrame([(False, 43, 100, 5, 0, 2), (True, 0, 500, 200, 30, 0)], "p boolean, d int, n int, o int, f int, s int")
    assert [r[0] for r in rows.select(scores.fit_score(*(F.col(c) for c in "pdnofs"))).collect()] == [27, 45]
    rows = spark.createDataFrame([(3, 0.0, True, 90), (None, 0.0, False, None)], "d int, r double, o boolean, e int")
    assert [r[0] for r in rows.select(scores.health_score(*(F.col(c) for c in "droe"))).collect()] == [100, 50]
    assert column(spark, [0, 1, 10, 11, 100, 101, 1000, 1001, -1], scores.count_bucket, "int") == ["0", "1-10", "1-10", "11-100", "11-100", "101-1k", "101-1k", "1k+", "unknown"]


def test_snapshot_deltas(spark):
    cur = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", None), ("b", "9")], "app string, id string")
    prev = spark.createDataFrame([("a", x) for x in "2345"], "app string, id string")
    got = {r.app: r for r in snapshots.with_total(snapshots.delta_counts(cur, prev, "app", ["id"]), "app").collect()}
    assert (got["a"].current, got["a"].previous, got["a"].new, got["a"].churned, got["a"].retained, got["a"].churn_rate) == (2, 4, 1, 3, 1, 0.75)
    assert (got["all_apps"].current, got["all_apps"].churn_rate, got["all_apps"].net_growth) == (3, 0.75, -1)
    log = cur.where("false").select("id")
    assert snapshots.churned_rows(cur, prev, ["id"]).count() == 3
    assert snapshots.churned_rows(cur, prev, ["id"], log).count() == 0
    md = reports.delta_markdown(snapshots.with_total(snapshots.delta_counts(cur, prev, "app", ["id"]), "app"), spark.createDataFrame([("a", "web", 2)], "app string, platform string, n long"), "s1", "s0")
    assert "| a | 2 | 1 | 3 | 75.0% |" in md and "- web: 2" in md


def test_order_spike_edges(spark):
    rows = [("a", 0, 5), ("b", 10, 15), ("c", 10, 14), ("d", 100, 149)]
    prev = spark.createDataFrame([(k, "Pro", o, 0) for k, o, _ in rows], "id string, plan string, orders long, failed long")
    cur = spark.createDataFrame([(k, "Pro", o, 0) for k, _, o in rows], "id string, plan string, orders long, failed long")
    assert sorted(r.id for r in snapshots.change_events(cur, prev, ["id"]).collect()) == ["a", "b"]


def test_gap_fill_and_empty(spark):
    rows = spark.createDataFrame([("a", "2026-01-03"), ("a", "2026-01-09"), ("a", "2026-03-01"), ("b", "2026-02-01"), ("b", None)], "app string, d string").withColumn("d", F.to_date("d"))
    got = {(r.app, r.period): r.n for r in series.fill_gaps(series.period_counts(rows, "app", "d", "month"), rows, "app", "month").collect()}
    assert (got["a", "2026-02"], got["b", "2026-02"]) == (0, 1)
    assert [got["all_apps", f"2026-0{m}"] for m in (1, 2, 3)] == [2, 1, 1]
    empty = rows.where("false")
    assert series.fill_gaps(series.period_counts(empty, "app", "d", "month"), empty, "app", "month").collect() == []


def test_rolling_ends(spark):
    rows = spark.createDataFrame([("a", d) for d in ("2026-04-20", "2026-04-15", "2026-03-21")], "app string, d string").withColumn("d", F.to_date("d"))
    got = series.rolling(rows, "app", "d", "2026-04-30").orderBy("day").collect()
    assert (len(got), got[-1].n, got[0].n, str(got[0].day)) == (91, 2, 0, "2026-01-30")


def test_segments_and_flows(spark):
    rows = spark.createDataFrame([("a", ""), ("a", None), ("a", "  "), ("a", "web")], "app string, p string")
    got = {(r.app, r.label): (r.n, float(r.coverage_pct)) for r in segments.breakdown(rows, "app", "p").collect()}
    assert got["a", "(not set)"] == (3, 25.0)
    flow = revenue.plan_flows(spark.createDataFrame([("A|A|B|C",), (None,)], "h string"), "h")
    assert [tuple(r) for r in flow.collect()] == [("A", "B", 1), ("B", "C", 1)]


def test_store(spark):
    stored = spark.createDataFrame([("1", "old", 1, 1), ("2", "old", None, 1)], "id string, plan string, locked int, last_seen int")
    scan = spark.createDataFrame([("1", "new", 2), ("2", "new", 2), ("3", "new", 2), (None, "x", 2)], "id string, plan string, last_seen int")
    got = {r.id: (r.plan, r.last_seen) for r in store.guarded_upsert(stored, scan, ["id"], ["plan"]).collect()}
    assert got == {"1": ("old", 2), "2": ("new", 2), "3": ("new", 2)}
    gate = store.row_count_gate(spark.createDataFrame([("a",)] * 10, "app string"), spark.createDataFrame([("a",)] * 100 + [("b",)] * 3, "app string"), "app")
    assert {r.app: r.status for r in gate.collect()} == {"a": "blocked", "b": "blocked"}
    assert store.schema_status(["a", "x"], ["a", "b"], []) == ("blocked", ["b"], ["x"])
    assert store.schema_status(["a", "x"], ["a"], [])[0] == "pending_review"


def test_sources(spark, tmp_path):
    run = {"run_stamp": "s1", "data": {"a": [{"seller_id": "1", "order_count": "1,234"}, {"seller_id": "2"}], "b": []}, "uninstalls": {"a": [{"seller_id": "9"}]}}
    (tmp_path / "run.json").write_text(json.dumps(run, indent=1))
    got = runs.read_runs(spark, str(tmp_path / "run.json"))
    assert [(r.app, r.pos, r.seller_id) for r in runs.seller_rows(got).orderBy("pos").collect()] == [("a", 0, "1"), ("a", 1, "2")]
    assert [r.seller_id for r in runs.uninstall_rows(got).collect()] == ["9"]
    rows = spark.createDataFrame([("1", 'say "x"\nand', None)], "seller_id string, plan string, extra string")
    runs.write_csv(rows, str(tmp_path / "csv"), ("seller_id", "plan", "email"))
    back = runs.read_csv(spark, str(tmp_path / "csv"), ("seller_id", "plan", "email", "none")).collect()
    assert [(r.seller_id, r.plan, r.email or "", r.none) for r in back] == [("1", 'say "x"\nand', "", None)]
    for stamp in ("s1", "s2", "s3"):
        runs.write_snapshot(spark.createDataFrame([(stamp, "a", 1)], "run_stamp string, app string, v int"), str(tmp_path / "snap"))
    snaps = spark.read.parquet(str(tmp_path / "snap"))
    assert [r.run_stamp for r in runs.previous_snapshot(snaps, "s3").collect()] == ["s2"]
    page = "<table><tr><th>Shop URL</th><th>Plan</th></tr><tr><td>a.b</td><td> Pro <b>1</b></td></tr><tr><td>c</td></tr></table><table><tr><td>x</td></tr></table>"
    grid = runs.html_grid(spark.createDataFrame([(page,), (None,), ("",)], "html string"), "html", ("shop_url", "plan")).collect()
    assert [tuple(r) for r in grid] == [("a.b", "Pro 1"), ("c", "")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30"), (1, "2024-01-01 00:03:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-02 06:00:00")], "user int, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {}

    def run(name, f):
        stream = f(flows.event_stream(spark, str(tmp_path / "in"), "user int, ts timestamp"))
        held = []
        query = flows.on_snapshots(stream, lambda df, _: held.extend(df.collect()), str(tmp_path / name))
        query.awaitTermination()
        seen[name] = held

    run("beats", lambda s: flows.heartbeats(s, "ts", "user"))
    run("sessions", lambda s: flows.sessions(s, "ts", "user"))
    run("days", lambda s: flows.windowed_counts(s, "ts", "user"))
    assert len(seen["beats"]) == 4
    assert sorted(r.n for r in seen["sessions"] if r.user == 1) == [1, 3]
    assert [(r.user, r.n) for r in seen["days"] if r.user == 1] == [(1, 4)]
