"""Streams of events: windowed counts, sessions, throttled heartbeats, snapshots as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import snapshots
from tidemark.operators.series import period_counts
from tidemark.sources.runs import append_metrics, commit_run, stamps
from tidemark.sources.versions import Versions


def event_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and key; events later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def rolling_counts(events: DataFrame, time: str, width: str = "30 days", step: str = "1 day", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "5 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, end, n) of runs of events with no gap of that length."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def heartbeats(events: DataFrame, time: str, key: str, every: str = "60 seconds", late: str = "2 hours") -> DataFrame:
    """One event for each key and fixed slot of ``every``; ``stateful.throttled`` counts from the last event that went on."""
    return events.withWatermark(time, late).withColumn("slot", F.window(time, every)["start"]).dropDuplicatesWithinWatermark([key, "slot"])


def snapshot_handler(history: str, metrics: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A handler for ``on_snapshots``: each arrival is held against the latest stored snapshot, its metrics are written, and it is stored.

    Rows have app, run_stamp, plan and the keys. The diff comes before the arrival is stored,
    and a stamp that is stored already is left out, so that a repeated batch adds nothing.
    Metrics of a stamp replace each other, so that a retry after a failure between the two
    writes does not repeat them. ``run_handler`` stores both in one commit.
    """

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = stamps(spark, history)
        for stamp in sorted(r[0] for r in batch.select("run_stamp").distinct().collect()):
            if stamp in known:
                continue
            now = batch.where(F.col("run_stamp") == stamp)
            before = spark.read.parquet(history).where(F.col("run_stamp") == known[0]) if known else now.where("false")
            counts = snapshots.with_total(snapshots.delta_counts(now, before, "app", keys), "app")
            append_metrics(snapshots.kpi_rows(counts, "app", stamp), metrics)
            now.write.mode("append").partitionBy("run_stamp").parquet(history)
            known = [stamp, *known]

    return handle


def run_handler(store: Versions, keys: list[str], uninstall_keys: list[str], registered: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A handler for ``on_snapshots`` that stores a run and its metrics exactly once.

    Rows have app, kind (sellers or uninstalls), run_stamp, platform and the keys of both kinds.
    A run is held against the latest rows of the store; then ``metric_rows``, uninstalls
    included, the run and the new latest rows become visible in one commit under the run's
    stamp. A failure before the commit leaves nothing to see, and a retry of what is committed
    does nothing.
    """

    def handle(batch: DataFrame, _: int) -> None:
        # a few stamps at a time
        for stamp in sorted(r[0] for r in batch.select("run_stamp").distinct().collect()):
            version, now = store.current(), batch.where(F.col("run_stamp") == stamp)
            if stamp in version.marks:
                continue
            before = version.read("latest") if version.has("latest") else now.where("false")
            before = before.join(now.select("app", "kind").distinct(), ["app", "kind"], "left_semi")
            kind = lambda df, name: df.where(F.col("kind") == name)
            sellers = snapshots.delta_counts(kind(now, "sellers"), kind(before, "sellers"), "app", keys)
            gone = snapshots.uninstall_counts(kind(now, "uninstalls"), kind(before, "uninstalls"), "app", uninstall_keys)
            platforms = kind(now, "sellers").where("platform is not null").groupBy("app", "platform").agg(F.count("*").alias("n"))
            metrics = snapshots.metric_rows(snapshots.run_report(sellers, gone, "app"), platforms, "app", stamp)
            commit_run(store, stamp, now.drop("run_stamp"), now.select("app").distinct(), registered, extra={"metrics": metrics})

    return handle


def install_counts(installs: DataFrame, time: str, period: str = "month") -> DataFrame:
    """(app, start, n) of a stream, for ``install_sink`` in update mode; the state has a count for each app and period.

    There is no watermark: an install counts in its period however late it comes.
    """
    return period_counts(installs, "app", time, period)


def install_sink(store: Versions, name: str = "installs") -> Callable[[DataFrame, int], None]:
    """A handler that keeps the series in ``store``: only the periods that changed are written anew.

    The part of a period has all its apps: the new counts, and the stored ones of other apps.
    A batch that is committed already is not applied again.
    """

    def handle(changed: DataFrame, batch: int) -> None:
        version, rows = store.current(), changed.persist()  # the state is read and written once
        if version.has(name):
            periods = [str(r[0]) for r in rows.select("start").distinct().collect()]  # of a calendar
            held = version.read(name, periods).alias("h")
            same = rows.select("app", "start").alias("c")
            rest = held.join(same, F.col("h.app").eqNullSafe(F.col("c.app")) & (F.col("h.start") == F.col("c.start")), "left_anti")
            changed = rows.unionByName(rest)
        store.commit(f"{name}-{batch}", put={name: (changed, "start")}, base=version)
        rows.unpersist()

    return handle


def log_sink(store: Versions, keys: list[str], name: str = "uninstalls") -> Callable[[DataFrame, int], None]:
    """A handler that adds entries of a log, those whose composite key is not stored yet; what is stored never changes."""

    def handle(batch: DataFrame, number: int) -> None:
        version = store.current()
        fresh = snapshots.keep_one(snapshots.blank_keys(batch, keys), keys, F.lit(0))
        if version.has(name):
            fresh = fresh.join(version.read(name).select(keys), keys, "left_anti")
        store.commit(f"{name}-{number}", append={name: fresh})

    return handle


def to_sink(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """As ``on_snapshots``, with counts in update mode."""
    writer = stream.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def shifted_rolling_counts(events: DataFrame, time: str, days: int = 30, late: str = "2 hours") -> DataFrame:
    """(day, n): events of the ``days`` whole days that end with ``day``, as the batch form counts them.

    Windows are closed at the left and open at the right, so the last day is the one before a window's end.
    """
    counts = events.withWatermark(time, late).groupBy(F.window(time, f"{days} days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counts.select(F.date_sub(F.to_date("w.end"), 1).alias("day"), "n")


def on_snapshots(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand each arrival to ``handle``; without ``every`` all that is there, once, as a scheduled run does."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
