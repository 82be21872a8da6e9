"""Committed versions, runs and streams that write through them: crashes, reruns, late and shuffled files."""

import json
import time
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import edits, gates, series, snapshots
from tidemark.operators import store as store_ops
from tidemark.plans import lifecycle, records, reports  # noqa: F401  queries are added there
from tidemark.plans.queries import ORACLE_SQL, QUERIES
from tidemark.sources import files, runs
from tidemark.sources.versions import Conflict, Versions
from tidemark.streaming import flows, stateful


def frame(spark, *rows):
    return spark.createDataFrame(rows, "app string, kind string, seller_id string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_commits_are_whole_and_once(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    assert store.current().number == 0 and not store.current().has("t")
    one, two = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(2, "x")], "v int, w string")
    assert store.commit("a", append={"t": one}, replace={"latest": one})
    assert not store.commit("a", append={"t": one}, replace={"latest": one})
    assert store.commit("b", append={"t": two}, replace={"latest": two})
    now = store.current()
    assert rows_of(now.read("t"), "v", "w") == [(1, None), (2, "x")] and now.parts("t") == ["b", "a"] and rows_of(now.read("t", ["a"]), "v") == [(1,)]
    assert rows_of(now.read("latest"), "v") == [(2,)] and rows_of(store.at(1).read("latest"), "v") == [(1,)]
    assert store.commit("a", append={"t": spark.createDataFrame([(9, "y")], "v int, w string")}, again=True)
    assert rows_of(store.current().read("t"), "v") == [(2,), (9,)]
    assert store.commit("empty", append={"t": two.where("false")}) and store.current().read("t").count() == 2


def test_a_killed_write_is_invisible(spark, tmp_path, monkeypatch):
    store = Versions(spark, str(tmp_path))
    df = spark.createDataFrame([(1,)], "v int")
    store.commit("a", append={"t": df})
    with monkeypatch.context() as m:
        m.setattr(files, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit("b", append={"t": df}, replace={"latest": df})
    assert store.current().number == 1 and store.current().read("t").count() == 1 and not store.current().has("latest")
    assert len(files.names(spark, f"{tmp_path}/t")) == 2
    assert store.expire() == 2 and len(files.names(spark, f"{tmp_path}/t")) == 1
    assert store.commit("b", append={"t": df}) and store.current().read("t").count() == 2


def test_writers_meet(spark, tmp_path):
    store, other = Versions(spark, str(tmp_path)), Versions(spark, str(tmp_path))
    df = spark.createDataFrame([(1,)], "v int")
    store.commit("a", replace={"latest": df})
    base = store.current()
    other.commit("b", append={"log": df})
    assert store.commit("c", append={"log": df}, base=base) and store.current().read("log").count() == 2
    assert not files.publish(spark, "{}", f"{tmp_path}/_versions/{3:012d}.json")
    other.commit("d", replace={"latest": df})
    with pytest.raises(Conflict, match="latest"):
        store.commit("e", replace={"latest": df}, base=base)
    assert "e" not in store.current().marks


def test_only_the_parts_put_change(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    kind = "k string, v int"
    store.commit("1", put={"t": (spark.createDataFrame([("a b/c", 1), ("z", 2), (None, 5)], kind), "k")})
    before = store.current().tables["t"]["parts"]
    store.commit("2", put={"t": (spark.createDataFrame([("z", 3), ("z", 4)], kind), "k")})
    after = store.current().tables["t"]["parts"]
    assert {p for p in after if after[p] != before.get(p)} == {"z"} and rows_of(store.current().read("t"), "k", "v") == [("a b/c", 1), ("z", 3), ("z", 4), (None, 5)]


def test_runs_are_merged_forward(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    apps = lambda *names: spark.createDataFrame([(n,) for n in names], "app string")
    first = frame(spark, ("a", "sellers", "1"), ("a", "uninstalls", "2"), ("b", "sellers", "3"), ("c", "sellers", "4"), ("old", "sellers", "5"))
    failed = spark.createDataFrame([("b", "login"), ("d", "later")], "app string, message string")
    assert runs.commit_run(store, "s1", first, apps("a", "b", "c", "old"), errors=failed)
    # b and c were reached and are empty now; old is no longer registered; a's uninstalls are blocked
    verdict = spark.createDataFrame([("a", "uninstalls", "blocked"), ("a", "sellers", "ok")], "app string, kind string, status string")
    second = frame(spark, ("a", "sellers", "6"), ("a", "uninstalls", "7"))
    told = dict(registered=apps("a", "b", "c", "d"), verdict=verdict, errors=spark.createDataFrame([("c", "timeout")], "app string, message string"))
    assert runs.commit_run(store, "s2", second, apps("a", "b", "c"), **told)
    assert not runs.commit_run(store, "s2", second, apps("a", "b", "c"), **told)
    now = store.current()
    assert rows_of(now.read("latest"), "app", "kind", "seller_id", "run_stamp") == [("a", "sellers", "6", "s2"), ("a", "uninstalls", "2", "s1")]
    assert rows_of(now.read("staging"), "seller_id") == [("7",)] and now.read("history").count() == 7
    assert rows_of(now.read("errors"), "app", "message") == [("c", "timeout"), ("d", "later")]
    assert runs.commit_run(store, "s3", second.where("false"), apps("z"), registered=apps().where("false")) and rows_of(store.current().read("latest"), "seller_id") == [("2",), ("6",)]


def test_reruns_of_simple_writers_add_nothing(spark, tmp_path):
    df = frame(spark, ("a", "sellers", "1"))
    stamped = df.withColumn("run_stamp", F.lit("s"))
    for _ in range(2):
        runs.persist_run(df, df, f"{tmp_path}/run", "s")
        runs.rotate(df, f"{tmp_path}/rows", "s")
        runs.write_snapshot(stamped, f"{tmp_path}/snap")
        runs.append_metrics(stamped, f"{tmp_path}/metrics")
        runs.append_alerts(stamped, f"{tmp_path}/alerts", "2026-01-01 00:00:00")
    now = Versions(spark, f"{tmp_path}/run").current()
    assert [now.read(t).count() for t in ("latest", "history", "staging")] == [1, 1, 1]
    assert [len(x.collect()) for x in runs.pair_of_history(spark, f"{tmp_path}/rows")] == [0, 1]
    assert [spark.read.parquet(f"{tmp_path}/{x}").count() for x in ("snap", "metrics", "alerts")] == [1, 1, 1]


def arrivals(spark, path, stamp, rows):
    kind = "app string, kind string, run_stamp string, platform string, seller_id string, day string"
    df = spark.createDataFrame([(a, k, stamp, p, s, d) for a, k, p, s, d in rows], kind)
    df.coalesce(1).write.mode("append").parquet(path)
    return flows.event_stream(spark, path, kind)


def test_handler_is_exactly_once(spark, tmp_path, monkeypatch):
    store = Versions(spark, f"{tmp_path}/store")
    handler = flows.run_handler(store, ["seller_id"], ["seller_id", "day"])
    run = lambda stream: flows.on_snapshots(stream, handler, f"{tmp_path}/checkpoint").awaitTermination()
    run(arrivals(spark, f"{tmp_path}/in", "s1", [("a", "sellers", "web", "1", None), ("a", "sellers", "app", "2", None), ("a", "uninstalls", None, "9", "d1")]))
    stream = arrivals(spark, f"{tmp_path}/in", "s2", [("a", "sellers", "web", "2", None), ("a", "sellers", "web", "3", None), ("a", "uninstalls", None, "9", "d1"), ("a", "uninstalls", None, "1", "d2"), ("b", "sellers", None, "5", None)])
    write, seen = Versions._write, []

    def fails(self, df, table, commit):
        """Stops after the metrics were written."""
        if seen and seen[-1] == "metrics":
            raise OSError("disk")
        seen.append(table)
        return write(self, df, table, commit)

    with monkeypatch.context() as m:
        m.setattr(Versions, "_write", fails)
        with pytest.raises(Exception, match="disk"):
            run(stream)
    assert "metrics" in seen and list(store.current().marks) == ["s1"]
    run(stream)
    handler(spark.read.parquet(f"{tmp_path}/in"), 99)
    now = store.current()
    got = {(r.app_name, r.metric_name): r.value for r in now.read("metrics", ["s2"]).collect()}
    assert len(got) == now.read("metrics", ["s2"]).count() == 20
    assert (got["a", "total_active"], got["a", "new_installs"], got["a", "churned_sellers"], got["a", "new_uninstalls"], got["a", "platform_split"]) == (2, 1, 1, 1, 1)
    assert (got[None, "total_active"], got[None, "new_installs"], got["b", "new_installs"]) == (3, 2, 1)
    assert now.read("history").count() == 8 and now.read("latest").count() == 5


def test_late_installs_change_their_periods_alone(spark, tmp_path):
    store, kind = Versions(spark, f"{tmp_path}/store"), "app string, at timestamp"

    def arrive(*rows):
        spark.createDataFrame(rows, "app string, d string").select("app", F.to_timestamp("d").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        flows.to_sink(flows.install_counts(flows.event_stream(spark, f"{tmp_path}/in", kind), "at"), flows.install_sink(store), f"{tmp_path}/c").awaitTermination()
        return dict(store.current().tables["installs"]["parts"])

    def recomputed():
        want = series.period_counts(spark.read.parquet(f"{tmp_path}/in"), "app", "at", "month")
        return rows_of(want, "app", "start", "n") == rows_of(store.current().read("installs"), "app", "start", "n")

    first = arrive(("a", "2026-01-05"), ("b", "2026-01-06"), ("a", "2026-03-01"), (None, "2026-02-01"))
    assert sorted(first) == ["2026-01-01", "2026-02-01", "2026-03-01"] and recomputed()
    second = arrive(("a", "2026-01-20"), ("c", "2025-11-01"), (None, "2026-01-02"))
    assert {p for p in second if second[p] != first.get(p)} == {"2025-11-01", "2026-01-01"} and recomputed()
    flows.install_sink(store)(spark.createDataFrame([("a", "2026-01-01", 99)], "app string, start string, n long").withColumn("start", F.to_date("start")), 0)
    assert recomputed()


def test_log_entries_are_added_once(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    sink, kind = flows.log_sink(store, ["seller_id", "day"]), "seller_id string, day string"
    sink(spark.createDataFrame([("1", "d"), ("1", "d"), (None, "d")], kind), 0)
    sink(spark.createDataFrame([("1", "d"), (None, "d"), ("2", None)], kind), 1)
    sink(spark.createDataFrame([("3", "d")], kind), 1)
    assert rows_of(store.current().read("uninstalls"), "seller_id", "day") == [("", "d"), ("1", "d"), ("2", "")]


def test_metrics_of_the_two_handlers_agree(spark):
    now = spark.createDataFrame([("a", "1"), ("a", "2")], "app string, id string")
    counts = snapshots.with_total(snapshots.delta_counts(now, now.where("id = '1'"), "app", ["id"]), "app")
    old = {(r.app, r.metric_name): r.value for r in snapshots.kpi_rows(counts, "app", "s").collect()}
    report = snapshots.run_report(snapshots.delta_counts(now, now.where("id = '1'"), "app", ["id"]), snapshots.uninstall_counts(now.where("false"), now.where("false"), "app", ["id"]), "app")
    new = {(r.app_name, r.metric_name): r.value for r in snapshots.metric_rows(report, spark.createDataFrame([], "app string, platform string, n long"), "app", "s").collect()}
    assert all(old[a, x] == new[a, y] for a in ("a", None) for x, y in (("current", "total_active"), ("new", "new_installs"), ("churned", "churned_sellers"), ("churn_rate", "churn_rate")))


@pytest.fixture()
def rocks(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def streamed(spark, path, schema, run, one=1):
    """Rows of a stream over files of a folder, and rows of state left."""
    held = []
    query = flows.on_snapshots(run(flows.event_stream(spark, path, schema, one)), lambda df, _: held.extend(map(tuple, df.collect())), f"{path}-c")
    query.awaitTermination()
    return sorted(held, key=str), query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def test_throttle_counts_from_the_last_beat(spark, tmp_path, rocks):
    beats = [("slot", 59), ("slot", 61), ("three", 0), ("three", 61), ("three", 122), ("three", 125), ("edge", 10), ("edge", 70), ("edge", 129), (None, 5), (None, 6)]
    df = spark.createDataFrame([*beats, ("end", 100_000)], "u string, s long").select(F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "u")
    df.where("u <> 'end' or u is null").orderBy(F.xxhash64("u", "ts")).repartition(4).write.parquet(f"{tmp_path}/in")
    df.where("u = 'end'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, left = streamed(spark, f"{tmp_path}/in", "ts timestamp, u string", lambda s: stateful.throttled(s, "ts", ["u"], late="1 hour"), 9)
    seconds = lambda u: [int(t.timestamp()) % 1_700_000_000 for t, x in got if x == u]
    assert seconds("slot") == [59] and seconds("three") == [0, 61, 122] and seconds("edge") == [10, 70] and seconds(None) == [5]
    assert left == 1  # the last beat, which waits


def test_page_changes_of_shuffled_files(spark, tmp_path, rocks):
    rows = [(u, i * 7 % 400, p) for i, (u, p) in enumerate((f"u{i % 5}", "ABAACCA"[i * i % 7] if i % 11 else None) for i in range(120))]
    df = spark.createDataFrame(rows, "u string, s long, page string").select(F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "u", "page")
    df.orderBy(F.xxhash64("ts", "u")).repartition(3).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", 200_000, "x")], "u string, s long, page string").select(F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "u", "page").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, left = streamed(spark, f"{tmp_path}/in", "ts timestamp, u string, page string", lambda s: stateful.page_changes(s, "ts", ["u"], "page", late="1 day", forget=3600), 9)
    want, last = [], {}
    for u, s, p in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "")):
        if u not in last or last[u] != p:
            want.append((u, s, p))
        last[u] = p
    assert sorted(((u, int(t.timestamp()) - 1_700_000_000, p) for t, u, p in got), key=str) == sorted(want, key=str) and left == 1


class _Handle:
    """Lists, values and timers of one key, and how often they are called."""

    def __init__(self):
        self.calls, self.timers, self.held, self.last = 0, set(), [], None

    def getListState(self, *_):  # noqa: N802
        return self

    def appendValue(self, piece):  # noqa: N802
        self.calls, self.held = self.calls + 1, [*self.held, piece]

    def getValueState(self, *_):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


def test_rows_of_a_key_wait_in_pieces_for_one_timer():
    handle, start = _Handle(), datetime(2026, 1, 1, tzinfo=timezone.utc)
    keyed = stateful.InOrder(["ts", "u"], "ts timestamp, u string", lambda last, row, since: (row, True), 1000)
    keyed.init(handle)
    keyed.handleInputRows(("a",), iter([Row(ts=start + timedelta(seconds=i * 7 % 1000), u="a") for i in range(1, 1000)]), None)
    assert handle.calls == 2 and len(handle.held) == 1 and handle.timers == {stateful._ms(start) + 1001}


def test_streams_of_many_files_lose_no_rows(spark, tmp_path):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    (tmp_path / "events.parquet").mkdir()
    for i in range(70):
        con.execute(f"copy (select * from '{sf}/events.parquet' where event_id % 70 = {i}) to '{tmp_path}/events.parquet/{i}.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    for name in ("streamed_page_changes", "streamed_beats"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_edits_are_logged_applied_and_locked(spark, tmp_path):
    store, at = Versions(spark, str(tmp_path)), lambda c: F.col(c).cast("timestamp_ntz")
    keys, data = ["app_name", "seller_id"], ["plan", "orders"]
    scan = lambda *rows: spark.createDataFrame(rows, "app_name string, seller_id string, plan string, orders string, scraped_at string, scanned_pos int").withColumn("scraped_at", at("scraped_at"))
    assert edits.commit_scan(store, "s1", scan(("a", "1", "Early", "1", "2026-01-01", 0), ("a", "1", "Free", "5", "2026-01-01", 1), ("a", "2", "Free", "x", "2026-01-01", 2), ("a", None, "Free", "1", "2026-01-01", 3)), keys, data, ("orders",))
    told = [("a", "1", "plan", "Pro", "me", "2026-01-02"), ("a", "1", "orders", "7", "me", "2026-01-03"), ("a", "1", "orders", "6", "me", "2026-01-02"), ("a", "9", "plan", "Pro", "me", "2026-01-02"), ("a", "1", "email", "x", "me", "2026-01-02"), ("a", "2", "plan", "Pro", " ", "2026-01-02"), ("a", "2", "plan", "Pro", "me", None)]
    edit = lambda rows: spark.createDataFrame(rows, "app_name string, seller_id string, field string, value string, editor string, edited_at string").withColumn("edited_at", at("edited_at"))
    checked = edits.checked_edits(edit(told), store.current().read("accounts"), keys, data)
    assert rows_of(checked, "seller_id", "field", "value", "old_value", "problem") == sorted([
        ("1", "plan", "Pro", "Free", None), ("1", "orders", "7", "5", None), ("1", "orders", "6", "5", None), ("9", "plan", "Pro", None, "unknown row"), ("1", "email", "x", None, "unknown field"), ("2", "plan", "Pro", "Free", "no editor"), ("2", "plan", "Pro", "Free", "no time"),
    ], key=str)
    assert edits.commit_edits(store, "e1", edit(told), keys, data) and not edits.commit_edits(store, "e1", edit(told), keys, data)
    # an earlier edit in a later batch is logged, and does not undo the later one
    assert edits.commit_edits(store, "e2", edit([("a", "1", "orders", "1", "me", "2026-01-01")]), keys, data)
    assert edits.commit_scan(store, "s2", scan(("a", "1", "Lite", "9", "2026-02-01", 0), ("a", "2", "Lite", "9", "2026-02-01", 1), ("b", "3", "Lite", "", "2026-02-01", 2)), keys, data, ("orders",))
    now = store.current()
    assert rows_of(now.read("accounts"), "seller_id", "plan", "orders") == [("1", "Pro", 7), ("2", "Lite", 9), ("3", "Lite", None)]
    assert [str(r[0])[:10] for r in now.read("accounts").where("seller_id = '1'").select("manually_edited_at").collect()] == ["2026-01-03"]
    assert now.read("edits").count() == 4 and rows_of(now.read("accounts_changes", ["s2"]), "change", "rows") == [("insert", 1), ("locked", 1), ("update", 1)]


def test_profiles_are_committed(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    made = lambda *rows: spark.createDataFrame(rows, "id string, insight string")
    assert edits.commit_profiles(store, "1", made(("a", "x"), ("b", "y")), ["id"]) and edits.commit_profiles(store, "2", made(("b", "z")), ["id"]) and not edits.commit_profiles(store, "2", made(("a", "no")), ["id"])
    assert rows_of(store.current().read("profiles"), "id", "insight") == [("a", "x"), ("b", "z")]


def test_registry_files(spark, tmp_path):
    apps = [{"id": "x", "label": " X app ", "schema_status": "canonical", "creds_ref": "A1", "frameworks": [" Web", "", "web", "App"], "later": 1}, {"id": "y", "creds_ref": ""}, {"label": "none"}]
    (tmp_path / "apps.json").write_text(json.dumps({"schema_version": 1, "apps": apps}, indent=1))
    found = runs.read_registry(spark, str(tmp_path / "apps.json"))
    assert rows_of(found, "pos", "app", "name", "status", "has_credentials", "blocked") == [(0, "x", "X app", "canonical", True, False), (1, "y", "y", "pending_review", False, False)]
    assert [r.frameworks for r in found.orderBy("pos").collect()] == [["web", "app"], ["auto"]] and runs.read_registry(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "grid.json").write_text(json.dumps({"default": {"required": ["Plan"], "optional": ["Email"]}, "apps": {"x": {"required": ["Plan", "Orders "]}}}))
    expected = runs.expected_columns(spark, str(tmp_path / "grid.json"), found)
    assert rows_of(expected, "app", "label", "required") == [("x", "Orders ", True), ("x", "Plan", True), ("y", "Email", False), ("y", "Plan", True)]
    seen = spark.createDataFrame([("x", "plan"), ("x", "New"), ("y", " PLAN ")], "app string, label string")
    assert {r.app: r.status for r in gates.grid_check(seen, expected, "app").collect()} == {"x": "blocked", "y": "ok"}
    assert runs.expected_columns(spark, str(tmp_path / "no.json"), found).count() == 0


def test_pairs_of_a_store_and_metrics_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("a", s, i) for s, n in (("s1", 1), ("s2", 2), ("s3", 3)) for i in range(n)] + [("b", "s1", 9)], "app string, run_stamp string, id int")
    before, now = runs.pair_of_store(df)
    assert (before.count(), now.count()) == (2, 4) and rows_of(now.where("app = 'b'"), "run_stamp") == [("s1",)] and before.where("app = 'b'").count() == 0
    for stamp in ("s1", "s2"):
        runs.append_metrics(df.where(F.col("run_stamp") == stamp), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).groupBy("run_stamp").count().count() == 2


def test_a_polling_stream_goes_on(spark, tmp_path):
    held = []
    df = spark.createDataFrame([("a", "s1")], "app string, run_stamp string")
    df.write.parquet(str(tmp_path / "in"))
    query = flows.on_snapshots(flows.event_stream(spark, str(tmp_path / "in"), "app string, run_stamp string"), lambda b, _: held.extend(b.collect()), str(tmp_path / "c"), every="1 second")
    try:
        for n in (1, 2):
            for _ in range(300):
                if len(held) >= n:
                    break
                time.sleep(0.1)
            assert len(held) == n and query.isActive
            df.write.mode("append").parquet(str(tmp_path / "in"))
    finally:
        query.stop()


def test_schema_section_of_the_report(spark):
    v = spark.createDataFrame([("a", "sellers", "ok", [])], "app string, kind string, status string, failed array<string>")
    md = reports.validation_markdown(v, "s", {"sellers": store_ops.schema_status(["a", "x"], ["a", "b"], []), "uninstalls": ("canonical", [], [])})
    assert "## Columns of sellers\n\nStatus: blocked\n\nMissing, the rows are not merged:\n- b\n\nUnknown, to be reviewed:\n- x\n" in md and "All required columns are there" in md
