"""Runs and snapshots on disk: run JSON, CSV, HTML grids, versioned Parquet snapshots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import files
from tidemark.sources.grids import grid_lines, grid_maps
from tidemark.sources.versions import Versions

# Field names of the run files.
SELLER_FIELDS = ("seller_id", "store_url", "username", "email", "platforms", "installed_on", "last_sync", "order_count", "product_count", "failed_order_count", "steps_completed", "source_country", "plan", "app_type", "webhooks", "action")
UNINSTALL_FIELDS = ("seller_id", "email", "username", "platform", "uninstalled_on", "shops_raw")


def _rows(fields: tuple[str, ...]) -> T.MapType:
    return T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields])))


RUN_SCHEMA = T.StructType([
    T.StructField("run_stamp", T.StringType()), T.StructField("data", _rows(SELLER_FIELDS)), T.StructField("uninstalls_data", _rows(UNINSTALL_FIELDS)),
    T.StructField("uninstalls", _rows(UNINSTALL_FIELDS)), T.StructField("app_errors", T.MapType(T.StringType(), T.StringType())),
])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path, multiLine=True)


def seller_rows(runs: DataFrame) -> DataFrame:
    """(run_stamp, app, pos, fields) of the runs' sellers."""
    apps = runs.select("run_stamp", F.explode("data").alias("app", "rows"))
    return apps.select("run_stamp", "app", F.posexplode("rows").alias("pos", "r")).select("run_stamp", "app", "pos", "r.*")


def uninstall_rows(runs: DataFrame) -> DataFrame:
    """As ``seller_rows``, from uninstalls_data or else uninstalls."""
    apps = runs.select("run_stamp", F.explode(F.coalesce("uninstalls_data", "uninstalls")).alias("app", "rows"))
    return apps.select("run_stamp", "app", F.posexplode("rows").alias("pos", "r")).select("run_stamp", "app", "pos", "r.*")


def read_csv(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """A CSV export with a header, quoted newlines and text columns; missing columns are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return raw.select(*(F.col(f"`{f}`").cast("string").alias(f) if f in raw.columns else F.lit(None).cast("string").alias(f) for f in fields))


def read_optional_csv(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """``read_csv``; no rows where there is no such file, as before the first rotation."""
    return read_csv(spark, path, fields) if files.exists(spark, path) else spark.createDataFrame([], ", ".join(f"`{f}` string" for f in fields))


def stamps(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in one, the latest stamp first."""
    return sorted((n.removeprefix("run_stamp=") for n in files.names(spark, folder, folders=True) if not n.startswith("_")), reverse=True)


def latest_run(spark: SparkSession, history: str, latest: str) -> tuple[str | None, DataFrame | None]:
    """The run of the latest stamp in ``history``, else the run in ``latest`` under the stamp __latest__, else none."""
    for stamp in stamps(spark, history):
        if files.exists(spark, f"{history}/{stamp}/run.json"):
            return stamp, read_runs(spark, f"{history}/{stamp}/run.json")
    return ("__latest__", read_runs(spark, f"{latest}/run.json")) if files.exists(spark, f"{latest}/run.json") else (None, None)


def pair_of_history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """Rows of the two latest stamps of ``rotate`` (before, now); with one stamp nothing was before, with none there is no pair."""
    now = Versions(spark, folder).current()
    found = now.parts("rows")[:2]
    return (now.read("rows", found[1:]), now.read("rows", found[:1])) if found else None


def pair_of_store(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of each app's two latest stamps (before, now)."""
    two = latest_snapshots(df, 2)
    return two.where("age = 2").drop("age"), two.where("age = 1").drop("age")


def first_full_pair(*sources: Callable[[], tuple[DataFrame, DataFrame] | None]) -> tuple[DataFrame, DataFrame] | None:
    """The first pair of which both sides have rows; later sources are not asked."""
    for source in sources:
        pair = source()
        if pair is not None and not pair[0].isEmpty() and not pair[1].isEmpty():
            return pair
    return None


def snapshot_row_counts(df: DataFrame) -> DataFrame:
    """(app, kind, n) of what a run left; whole rows count, so that quoted newlines do not."""
    return df.groupBy("app", "kind").agg(F.count("*").alias("n"))


def union_rows(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in the order in which columns are first seen; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rotate(df: DataFrame, folder: str, stamp: str) -> None:
    """Commit a run as ``stamp``, in place of an earlier one of that stamp; readers find the latest and the one before by stamp."""
    Versions(df.sparkSession, folder).commit(stamp, append={"rows": df.withColumn("run_stamp", F.lit(stamp))}, again=True)


def persist_run(promoted: DataFrame, staged: DataFrame, folder: str, stamp: str) -> bool:
    """The rows that readers see become latest and are added to history, blocked ones are added to staging, in one commit.

    A stamp that is there already changes nothing, and the result is False.
    """
    told = [df.withColumn("run_stamp", F.lit(stamp)) for df in (promoted, staged)]
    return Versions(promoted.sparkSession, folder).commit(stamp, replace={"latest": told[0]}, append={"history": told[0], "staging": told[1]})


def commit_run(store: Versions, stamp: str, rows: DataFrame, touched: DataFrame, registered: DataFrame | None = None, verdict: DataFrame | None = None, errors: DataFrame | None = None, extra: dict[str, DataFrame] | None = None) -> bool:
    """Commit a run: its rows (app, kind, ...) to history, what readers see to latest, blocked ones to staging.

    ``touched`` (app) are the apps that the run reached, those with errors or without rows
    included: their earlier rows and errors go, also where nothing came instead. Others stay as
    they were, if they are in ``registered`` (app); without a registry, or with an empty one,
    all count. ``verdict`` (app, kind, status) keeps the latest rows of what is blocked.
    ``errors`` are (app, message); ``extra`` are tables to which rows are added in the same
    commit. A stamp that is there already changes nothing, and the result is False.
    """
    now = store.current()
    if stamp in now.marks:
        return False
    spark = rows.sparkSession
    told = rows.withColumn("run_stamp", F.lit(stamp))
    prior = now.read("latest") if now.has("latest") else told.where("false")
    blocked = (verdict.where("status = 'blocked'") if verdict is not None else spark.createDataFrame([], "app string, kind string")).select("app", "kind").distinct()
    fresh = told.join(blocked, ["app", "kind"], "left_anti")
    known = prior if registered is None or registered.isEmpty() else prior.join(registered.select("app").distinct(), "app", "left_semi")
    apps = touched.select("app").unionByName(rows.select("app")).distinct()
    # of a touched app only blocked kinds stay
    kept = known.join(apps, "app", "left_anti").unionByName(known.join(apps, "app", "left_semi").join(blocked, ["app", "kind"], "left_semi"))
    new = (spark.createDataFrame([], "app string, message string") if errors is None else errors.select("app", "message")).withColumn("run_stamp", F.lit(stamp))
    old = now.read("errors") if now.has("errors") else new.where("false")
    old = old if registered is None or registered.isEmpty() else old.join(registered.select("app").distinct(), "app", "left_semi")
    return store.commit(
        stamp, replace={"latest": fresh.unionByName(kept, allowMissingColumns=True), "errors": new.unionByName(old.join(apps.unionByName(new.select("app")).distinct(), "app", "left_anti"))},
        append={"history": told, "staging": told.join(blocked, ["app", "kind"], "left_semi"), **(extra or {})}, base=now,
    )


def _put(rows: DataFrame, path: str, *by: str) -> None:
    """Add rows under ``by``; those of the same values are replaced, so that a rerun adds nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Metrics under their run_stamp, in place of earlier ones of that stamp."""
    _put(rows, path, "run_stamp")


def append_alerts(rows: DataFrame, path: str, created_at: str) -> None:
    """Alerts (run_stamp, app, level, message) with the time they were made, in place of those of the same stamp."""
    _put(rows.withColumn("created_at", F.lit(created_at).cast("timestamp_ntz")), path, "run_stamp")


def registry(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Registered apps of a configuration, in its order; keys that are not known are left out, missing ones have defaults."""
    rows = [(i, str(e["app"]), str(e.get("name", e["app"])), str(e.get("status", "pending_review")), bool(e.get("has_credentials", False)), bool(e.get("blocked", False)), list(e.get("frameworks", ["auto"]))) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "pos long, app string, name string, status string, has_credentials boolean, blocked boolean, frameworks array<string>")


_LABELS = "struct<required:array<string>,optional:array<string>>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """As ``registry``, from a JSON file {"apps": [{"id", "label", "schema_status", "creds_ref", "blocked", "frameworks"}]}; no rows where it is missing.

    An app without an id is left out, one without a label has its id for it, and one without
    frameworks is auto. It has credentials where it refers to some.
    """
    kind = "apps array<struct<id:string,label:string,schema_status:string,creds_ref:string,blocked:boolean,frameworks:array<string>>>"
    if not files.exists(spark, path):
        return registry(spark, [])
    a = spark.read.schema(kind).json(path, multiLine=True).select(F.posexplode("apps").alias("pos", "a")).where("coalesce(trim(a.id), '') <> ''")
    given = F.filter(F.transform(F.coalesce("a.frameworks", F.array().cast("array<string>")), lambda f: F.lower(F.trim(f))), lambda f: f != "")
    return a.select(
        F.col("pos").cast("long").alias("pos"), F.col("a.id").alias("app"), F.coalesce(F.nullif(F.trim("a.label"), F.lit("")), "a.id").alias("name"), F.coalesce("a.schema_status", F.lit("pending_review")).alias("status"),
        (F.trim(F.coalesce("a.creds_ref", F.lit(""))) != "").alias("has_credentials"), F.coalesce("a.blocked", F.lit(False)).alias("blocked"), F.when(F.size(given) > 0, F.array_distinct(given)).otherwise(F.array(F.lit("auto"))).alias("frameworks"),
    )


def expected_columns(spark: SparkSession, path: str, apps: DataFrame) -> DataFrame:
    """(app, label, required) that a grid of each of ``apps`` (app) should have, from a JSON file {"default": ..., "apps": {app: ...}}.

    Each entry has lists ``required`` and ``optional``; an app without one has the default's,
    and without a file nothing is expected. The file is small, and its entries are broadcast.
    """
    none = spark.createDataFrame([], "app string, label string, required boolean")
    if not files.exists(spark, path):
        return none
    config = spark.read.schema(f"default {_LABELS}, apps map<string,{_LABELS}>").json(path, multiLine=True)
    labels = lambda part, required: F.transform(F.coalesce(part, F.array().cast("array<string>")), lambda x: F.struct(x.alias("label"), F.lit(required).alias("required")))
    own = F.coalesce(F.try_element_at("apps", F.col("app")), F.col("default"))
    each = apps.select("app").distinct().crossJoin(F.broadcast(config)).select("app", own.alias("own"))
    return each.select("app", F.explode(F.concat(labels(F.col("own.required"), True), labels(F.col("own.optional"), False))).alias("x")).select("app", "x.label", "x.required")


def write_csv(df: DataFrame, path: str, fields: tuple[str, ...]) -> None:
    """Fixed columns, blanks for missing values and columns, extras left out."""
    rows = df.select(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields))
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def write_snapshot(df: DataFrame, path: str) -> None:
    """Add rows under run_stamp and app, so that both prune on reading; a rerun of a stamp replaces its apps."""
    _put(df, path, "run_stamp", "app")


def latest_snapshots(df: DataFrame, n: int = 2) -> DataFrame:
    """Rows of each app's ``n`` latest stamps, with ``age`` 1 for the latest; one pass over the stamps alone."""
    stamps = df.select("app", "run_stamp").distinct()
    ranked = stamps.withColumn("age", F.row_number().over(Window.partitionBy("app").orderBy(F.desc("run_stamp")))).where(F.col("age") <= n)
    return df.join(ranked, ["app", "run_stamp"])


def previous_snapshot(df: DataFrame, current_stamp: str | None = None) -> DataFrame:
    """Of each app's two latest stamps the first that isn't ``current_stamp``, by default the latest of all."""
    two = latest_snapshots(df, 2)
    if current_stamp is None:
        last = df.agg(F.max("run_stamp").alias("_last"))
        two = two.join(F.broadcast(last), F.col("run_stamp") != F.col("_last")).drop("_last")
    else:
        two = two.where(F.col("run_stamp") != current_stamp)
    first = two.groupBy("app").agg(F.min("age").alias("age"))
    return two.join(first, ["app", "age"]).drop("age")


def html_grid(pages: DataFrame, html_col: str, columns: tuple[str, ...], match: str | None = None) -> DataFrame:
    """Rows of each page's largest table, of those with a header that matches, in the order of pages; columns by their header in lower case with underscores, missing cells empty."""
    lines = grid_lines(pages.select(F.monotonically_increasing_id().alias("page"), F.col(html_col).alias("html")), "page", "html")
    rows = grid_maps(lines, match).orderBy("page", "row")
    return rows.select(*(F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit("")).alias(c) for c in columns))
