"""Changes of stored tables as commits: edits by hand with their log, scans, made profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.snapshots import keep_one
from tidemark.operators.store import locked_by_edits, overlay_edits, upsert_accounts, upsert_profiles
from tidemark.sources.versions import Versions


def checked_edits(edits: DataFrame, stored: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``edits`` (keys, field, value, editor, edited_at) with ``old_value`` of the stored row and ``problem``.

    A problem is "unknown field" where the field may not be edited, "unknown row" where no
    stored row has the keys, "no editor" or "no time" where one is missing, else null.
    """
    cells = stored.select(*keys, *(F.col(f).cast("string").alias(f) for f in fields), F.lit(True).alias("_known"))
    value = F.coalesce(*(F.when(F.col("field") == f, F.struct(F.col(f"_c_{f}").alias("v"))) for f in fields))["v"]
    both = edits.join(cells.select(*keys, *(F.col(f).alias(f"_c_{f}") for f in fields), "_known"), keys, "left")
    problem = (
        F.when(~F.coalesce(F.col("field").isin(*fields), F.lit(False)), "unknown field").when(F.col("_known").isNull(), "unknown row")
        .when(F.trim(F.coalesce("editor", F.lit(""))) == "", "no editor").when(F.col("edited_at").isNull(), "no time")
    )
    return both.select(*edits.columns, value.alias("old_value"), problem.alias("problem"))


def commit_edits(store: Versions, batch: str, edits: DataFrame, keys: list[str], fields: list[str], table: str = "accounts", log: str = "edits") -> bool:
    """Add the edits without a problem to the log, put their values in place and lock their rows, in one commit.

    Of several edits of a field the latest counts, and it never loses to an earlier one that
    comes in a later batch. A batch that is there already changes nothing, and the result
    is False. ``checked_edits`` tells what was left out.
    """
    now = store.current()
    if batch in now.marks:
        return False
    stored = now.read(table)
    good = checked_edits(edits, stored, keys, fields).where("problem is null").drop("problem").withColumn("batch", F.lit(batch))
    last = good
    if now.has(log):
        seen = now.read(log).groupBy(*keys, "field").agg(F.max("edited_at").alias("_seen"))
        last = good.join(seen, [*keys, "field"], "left").where(F.col("_seen").isNull() | (F.col("_seen") <= F.col("edited_at"))).drop("_seen")
    # values are text in the log, and what they are in the table
    changed = overlay_edits(stored.select(*(F.col(c).cast("string") if c in fields else F.col(c) for c in stored.columns)), last, keys, fields)
    typed = changed.select(*(F.col(c).try_cast(stored.schema[c].dataType).alias(c) if c in fields else F.col(c) for c in stored.columns))
    return store.commit(batch, replace={table: locked_by_edits(typed, good, keys).select(*stored.columns)}, append={log: good}, base=now)


def commit_scan(store: Versions, stamp: str, scanned: DataFrame, keys: list[str], data: list[str], integers: tuple[str, ...] = (), table: str = "accounts") -> bool:
    """``upsert_accounts`` of the stored table in one commit under the run's stamp; repeated keys count by ``scanned_pos``, the last, where it is told."""
    now = store.current()
    if stamp in now.marks:
        return False
    rows = keep_one(scanned, keys, F.col("scanned_pos"), last=True) if "scanned_pos" in scanned.columns else scanned
    held = [*keys, *data, "manually_edited_at", "first_seen_at", "last_scraped_at"]
    if now.has(table):
        stored = now.read(table)
    else:
        none = {"manually_edited_at": F.lit(None).cast("timestamp_ntz"), "first_seen_at": F.col("scraped_at"), "last_scraped_at": F.col("scraped_at")}
        stored = rows.withColumns(none | {c: F.col(c).try_cast("long") for c in integers}).select(*held).where("false")
    out = upsert_accounts(stored, rows, keys, data, integers)
    changes = out.groupBy("change").agg(F.count("*").alias("rows")).withColumn("run_stamp", F.lit(stamp))
    return store.commit(stamp, replace={table: out.select(*held)}, append={f"{table}_changes": changes}, base=now)


def commit_profiles(store: Versions, mark: str, made: DataFrame, keys: list[str], table: str = "profiles") -> bool:
    """``made`` profiles in place of cached ones of the same keys, in one commit."""
    now = store.current()
    cached = now.read(table) if now.has(table) else made.where("false")
    return store.commit(mark, replace={table: upsert_profiles(cached, made, keys)}, base=now)
