"""Grids with spans and several head rows, headers by page, keys by first sight, counts of the writing job, lookups, payloads."""

import json
import re

from pyspark.sql import functions as F

from tidemark.operators import payload, rows, store
from tidemark.plans import records
from tidemark.sources import grids, runs


def page(table):
    return f"<html><form><table><tr><td>filter</td></tr><tr><td>x</td></tr><tr><td>y</td></tr><tr><td>z</td></tr></table></form>{table}</html>"


def maps(spark, html, match=None):
    lines = grids.grid_lines(spark.createDataFrame([(1, html), (2, None), (3, "")], "page int, html string"), "page", "html")
    return [r.cells for r in grids.grid_maps(lines, match).orderBy("page", "row").collect()]


def test_spans(spark):
    wide = "<table><tr><th colspan=2>A</th><th>B</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"
    assert maps(spark, wide) == [{"a": "2", "b": "3"}]
    high = "<table><tr><th>A<th>B<th>C</tr><tr><td rowspan='2'>1</td><td>2</td><td>3</td></tr><tr><td>4</td><td rowspan=0>5</td></tr><tr><td>6<td>7</tr><tr></tr></table>"
    assert maps(spark, high) == [{"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "4", "c": "5"}, {"a": "6", "b": "7", "c": "5"}, {"a": "", "b": "", "c": "5"}]
    both = "<table><tr><th>A</th><th>B</th><th>C</th></tr><tr><td colspan=2 rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr><tr><td colspan=junk>p</td></tr></table>"
    assert maps(spark, both) == [{"a": "x", "b": "x", "c": "1"}, {"a": "x", "b": "x", "c": "2"}, {"a": "p", "b": "", "c": ""}]


def test_heads(spark):
    two = "<table><thead><tr><th></th><th>Mid</th><th>Shop  Url</th><th>Mid</th></tr><tr><td><input></td><td>any</td><td>any</td></tr></thead><tbody><tr><td>1</td><td>m</td><td>u</td><td>n</td></tr></tbody></table>"
    assert maps(spark, page(two), "Mid|Shop") == [{"shop_url": "u", "mid": "n"}]
    assert maps(spark, page(two), "absent") == []
    rows_of_heads = "<table><tr><th>A</th><th>B</th></tr><tr><th>w</th><th>w</th></tr><tr><th>row</th><td>2</td></tr></table>"
    assert maps(spark, rows_of_heads) == [{"a": "row", "b": "2"}]
    bare = "<table><tr><td>A</td></tr><tr><td>1</td></tr></table>"
    assert maps(spark, bare) == [{"a": "1"}]
    nested = "<table><tr><th>A</th><th>B</th></tr><tr><td>1<table><tr><th>Q</th></tr><tr><td>q</td></tr></table>!</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    assert maps(spark, nested) == [{"a": "1!", "b": "2"}, {"a": "3", "b": "4"}] and maps(spark, nested, "Q") == [{"q": "q"}]
    got = runs.html_grid(spark.createDataFrame([(page(two),), (None,)], "html string"), "html", ("mid", "none"), "Mid")
    assert [tuple(r) for r in got.collect()] == [("n", "")]


def test_pages_are_parsed_once_and_not_shuffled(spark, tmp_path):
    one = "<table><tr><th>A</th></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(5000)) + "</table>"
    pages = spark.createDataFrame([(1, page(one)), (1, "<table><tr><th>B</th></tr><tr><td>b</td></tr></table>"), (None, page(one))], "page int, html string")
    found = grids.grid_maps(grids.grid_lines(pages, "page", "html"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert sorted((r.page or 0, r.row, *r.cells.items()) for r in found.collect()) == sorted([(p, i + 1, ("a", str(i))) for p in (0, 1) for i in range(5000)] + [(1, 1, ("b", "b"))])


def test_panel_grid_spans_the_kind_of_a_pages_first_three(spark, tmp_path, monkeypatch):
    kinds = ["b", "a", "b", "a", "a", "a"] + ["b", None, None] + ["a", "b"] + ["1 < 2 &amp; <b>3"]
    keys = [1, 2, 3, 4, 5, 6, 400, 401, 402, 800, 801, 1200]
    orders = [(k, None if k == 5 else 10 * k, "" if k == 6 else None if k == 2 else "O", kind) for k, kind in zip(keys, kinds, strict=True)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    made, read = [], grids.grid_lines
    monkeypatch.setattr(grids, "grid_lines", lambda pages, *columns: made.append(pages) or read(pages, *columns))
    got = records.panel_grid(spark, str(tmp_path)).select("page", "order", "customer", "kind", "status").collect()
    html = {r.page: r.html for r in made[0].collect()}
    assert {p: re.findall(r"rowspan='?(\d+)", h) for p, h in html.items()} == {0: ["3"], 1: ["2"], 2: ["1"], 3: ["1"]}
    assert {p: h.count("<td colspan='2'") for p, h in html.items()} == {0: 4, 1: 2, 2: 2, 3: 1}
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [(k // 400, k, None if c is None else str(c), kind, status) for k, c, status, kind in orders]


def test_headers_by_page(spark):
    aliases = {"seller_id": ("seller id",), "email": ("email id", "email"), "store_url": ("store url",), "plan": ("plan",)}
    heads = [(1, 0, "Seller ID"), (1, 1, " E-mail"), (1, 2, "User  Email"), (1, 3, "Store URL"), (2, 0, "Plan details"), (2, 1, "Plan"), (2, 2, "EMAIL id"), (2, 3, "Seller Id"), (3, 0, "?")]
    lines = [(1, "k1", ["7", "no", " a  b ", "x.com//"]), (1, "k2", ["", "no"]), (2, "k3", ["Pro", "Lite", "e", "9", "extra"]), (3, "k4", ["a", "b"]), (1, "k5", ["one"]), (4, "k6", ["a", "b"])]
    got = rows.extract_pages(spark.createDataFrame(lines, "page int, row_key string, cells array<string>"), spark.createDataFrame(heads, "page int, pos int, header string"), aliases, "row_key")
    assert {r.row_key: (r.seller_id, r.email, r.store_url, r.plan) for r in got.collect()} == {
        "k1": ("7", "a b", "x.com", ""), "k2": ("k2", "", "", ""), "k3": ("9", "e", "", "Pro"), "k4": ("k4", "", "", ""), "k6": ("k6", "", "", ""),
    }
    for p in (1, 2):
        names = [h for q, _, h in heads if q == p]
        alone = rows.resolve_headers(names, aliases)
        places = rows.fields_by_page(spark.createDataFrame(heads, "page int, pos int, header string"), aliases).where(F.col("page") == p).first().places
        assert places == {f: names.index(h) for f, h in alone.items()}


def test_keys_in_the_order_of_first_sight(spark):
    every = [(2, 1, {"z": "1", "a": "2"}), (1, 2, {"c": "3", "b": "4"}), (1, 1, {"b": "5"}), (3, 1, {}), (3, 2, None), (2, 2, {"a": None, "d": "6"})]
    lists = [(f, p, None if c is None else list(c), None if c is None else list(c.values())) for f, p, c in every]
    df = spark.createDataFrame(lists, "file int, pos int, k array<string>, v array<string>").repartition(4).withColumn("cells", F.map_from_arrays("k", "v"))
    keys = []
    for _, _, cells in sorted(every, key=lambda r: r[:2]):
        keys += [k for k in cells or {} if k not in keys]
    order = (F.col("file"), F.col("pos"))
    assert grids.key_order(df, "cells", *order) == keys == ["b", "c", "z", "a", "d"]
    assert sorted(tuple(r) for r in grids.united(df, "cells", *order).collect()) == sorted(tuple((c or {}).get(k) or "" for k in keys) for _, _, c in every)


def test_counts_of_the_job_that_writes(spark, tmp_path):
    data = [("View", "1/2/2026", "a"), ("web", "soon", ""), ("web", "1/2", " "), (None, None, "b"), ("2026-02-18", "", "c")]
    spark.createDataFrame(data, "platforms string, installed_on string, email string").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    rules = {"shifted": rows.shifted(F.col("platforms"), F.col("installed_on")), "view": F.col("platforms") == "View"}
    kept, seen = rows.counted(df, ["platforms", "email"], rules)
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    kept.write.parquet(f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    two_pass = {r.field: r.populated for r in store.populated(back, ["platforms", "email"]).collect()}
    assert seen.get == {"rows": 5, "kept": 2, "reject_shifted": df.where(rules["shifted"]).count(), "reject_view": 1, "told_platforms": two_pass["platforms"], "told_email": two_pass["email"]} and back.count() == 2


def test_lookups_read_few_rows(spark, tmp_path):
    n, path = 40_000, f"{tmp_path}/store"
    df = spark.range(n).select(F.concat(F.lit("app"), F.col("id") % 5).alias("app_name"), F.sha2(F.col("id").cast("string"), 256).alias("seller_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("manually_edited_at"), F.col("id").alias("last_scraped_at"))
    store.write_lookup(df, path, ["app_name", "seller_id"], rows_a_group=1000)
    wanted = df.where("id = 0" if "id" in df.columns else "last_scraped_at = 12344").first()
    found = store.lookup(spark, path, app_name=wanted.app_name, seller_id=wanted.seller_id)
    assert [tuple(r) for r in found.collect()] == [tuple(wanted)]

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))

    assert 0 < scanned(store.matching(spark, path, seller_id=wanted.seller_id)) <= 2000 and scanned(store.matching(spark, path, app_name="app2", seller_id="none")) <= 2000
    assert store.lookup(spark, path, edited=True, limit=3, app_name="app2").select("last_scraped_at").collect()[0][0] == n - 8


def test_payloads(spark):
    objects = [
        {"app_name": "a", "seller_id": 7, "plan": "Pro", "order_count": "12", "z": {"x": [1, None]}, "run_stamp": "no"}, {"app_name": "a", "seller_id": "8", "plan": None, "order_count": "1,2", "extra_fields": {"q": 1, "z": "own"}, "z": "late"},
        {"app_name": "a"}, {"app_name": "", "seller_id": "9"}, 5, {"app_name": "a", "seller_id": "7", "plan": ["x", 1], "order_count": 3.0, "flag": True}, {"app_name": "a", "seller_id": "1", "plan": "new", "order_count": ""},
    ]
    texts = [(json.dumps(objects),), ("{}",), (None,), ("[",), ('[{"app_name":"b","seller_id":"1","order_count":"4"}]',)]
    df = spark.createDataFrame(texts, "p string")
    got = {(r.app_name, r.seller_id): (r.plan, r.order_count, r.extra_fields) for r in payload.payload_rows(df, "p", ["app_name", "seller_id"], ["plan", "order_count"]).collect()}
    assert got == {("a", "7"): ('["x",1]', "3", {"flag": "true"}), ("a", "8"): (None, "1,2", {"q": "1", "z": '"own"'}), ("a", "1"): ("new", "", None), ("b", "1"): (None, "4", None)}
    stored = spark.createDataFrame([("a", "1", "kept", 5, None, "2026-01-01", "2025-01-01", "2026-01-01"), ("a", "8", "old", 6, None, None, "2025-01-01", "2026-01-01")], "app_name string, seller_id string, plan string, order_count long, extra_fields map<string,string>, manually_edited_at string, first_seen_at string, last_scraped_at string")
    stored = stored.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("manually_edited_at", "first_seen_at", "last_scraped_at")})
    after = {(r.app_name, r.seller_id): (r.plan, r.order_count, r.change) for r in payload.upsert_payload(stored, df, "p", ["app_name", "seller_id"], ["plan", "order_count"], "2026-02-01", ("order_count",)).collect()}
    assert after == {("a", "1"): ("kept", 5, "locked"), ("a", "8"): (None, None, "update"), ("a", "7"): ('["x",1]', 3, "insert"), ("b", "1"): (None, 4, "insert")}
