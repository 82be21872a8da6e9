"""Stored tables: guarded upsert, manual overlays, merging runs forward, data-quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.gates import pagination_check, row_drop_check
from tidemark.operators.snapshots import keep_one


def guarded_upsert(stored: DataFrame, scanned: DataFrame, keys: list[str], data: list[str], locked: str = "locked", seen: str = "last_seen") -> DataFrame:
    """``stored`` after ``scanned`` came in: locked rows keep their data, ``seen`` always advances, new rows come in unlocked."""
    old = stored.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in [*data, locked, seen]), F.lit(True).alias("_old"))
    new = scanned.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, *(F.col(c).alias(f"_n_{c}") for c in [*data, seen]), F.lit(True).alias("_new"))
    both = old.join(new, keys, "full_outer")
    take = F.col("_new").isNotNull() & (F.col("_old").isNull() | F.col(f"_o_{locked}").isNull())
    values = [F.when(take, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in data]
    return both.select(*keys, *values, F.col(f"_o_{locked}").alias(locked), F.coalesce(F.col(f"_n_{seen}"), F.col(f"_o_{seen}")).alias(seen))


def upsert_accounts(stored: DataFrame, scanned: DataFrame, keys: list[str], data: list[str], integers: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` (keys, data, manually_edited_at, first_seen_at, last_scraped_at) after ``scanned`` (keys, data as text, scraped_at).

    Rows without a told key are left out. Integers are read where they are such, else null,
    so that one bad cell costs no batch. Rows edited by hand keep their data; the time of the
    last scan always advances and that of the first stays. ``change`` is insert, update, locked
    or kept, of which the first three make the count of rows written.
    """
    whole = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("long") if c in integers else F.col(c)
    told = scanned.where(" and ".join(f"coalesce(cast({k} as string), '') <> ''" for k in keys))
    new = told.select(*keys, *(whole(c).alias(f"_n_{c}") for c in data), F.col("scraped_at").alias("_at"))
    old = stored.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in data), "manually_edited_at", "first_seen_at", "last_scraped_at", F.lit(True).alias("_old"))
    both = old.join(new, keys, "full_outer")
    take = F.col("_at").isNotNull() & F.col("manually_edited_at").isNull()
    change = F.when(F.col("_at").isNull(), "kept").when(F.col("_old").isNull(), "insert").when(take, "update").otherwise("locked")
    return both.select(
        *keys, *(F.when(take, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in data), "manually_edited_at",
        F.coalesce("first_seen_at", "_at").alias("first_seen_at"), F.coalesce(F.greatest("last_scraped_at", "_at"), "last_scraped_at", "_at").alias("last_scraped_at"), change.alias("change"),
    )


def locked_by_edits(stored: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with manually_edited_at moved up to the last edit (keys, edited_at) of each row, never back."""
    last = edits.groupBy(*keys).agg(F.max("edited_at").alias("_edited"))
    return stored.join(last, keys, "left").withColumn("manually_edited_at", F.greatest("manually_edited_at", "_edited")).drop("_edited")


def merge_sessions(stored: DataFrame, beats: DataFrame, key: str) -> DataFrame:
    """Stored sessions (key, page, user_agent, started_at, last_seen) after heartbeats (key, page, user_agent, at).

    Page and last_seen are those of the last beat, a told user agent stays where a beat has
    none, and started_at stays.
    """
    last = beats.groupBy(key).agg(F.max_by("page", "at").alias("_page"), F.max_by("user_agent", F.when(F.col("user_agent").isNotNull(), F.col("at"))).alias("_agent"), F.min("at").alias("_first"), F.max("at").alias("_last"))
    both = stored.join(last, key, "full_outer")
    later = F.col("_last").isNotNull() & (F.col("last_seen").isNull() | (F.col("_last") >= F.col("last_seen")))
    return both.select(
        key, F.when(later, F.col("_page")).otherwise(F.col("page")).alias("page"), F.when(later, F.coalesce("_agent", "user_agent")).otherwise(F.coalesce("user_agent", "_agent")).alias("user_agent"),
        F.coalesce("started_at", "_first").alias("started_at"), F.greatest("last_seen", "_last").alias("last_seen"),
    )


def fresh_profiles(cache: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Cached rows not older than ``days`` days."""
    return cache.where(F.col("cached_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def profiles_to_make(rows: DataFrame, cache: DataFrame, keys: list[str], now: str, days: int = 30) -> DataFrame:
    """Rows whose profile is not in the cache, or too old."""
    return rows.join(fresh_profiles(cache, now, days).select(*keys).distinct(), keys, "left_anti")


def upsert_profiles(cache: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """``made`` and the cached rows of other keys."""
    return made.unionByName(cache.join(made.select(*keys).distinct(), keys, "left_anti"))


def enrichment_stats(profiles: DataFrame) -> DataFrame:
    """(total, processed, hits, errors) by where profiles (source) came from."""
    return profiles.agg(F.count("*").alias("total"), F.count_if(F.col("source") == "model").alias("processed"), F.count_if(F.col("source") == "cache").alias("hits"), F.count_if(F.col("source") == "error").alias("errors"))


def edited_rows(stored: DataFrame, app: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows edited by hand, the latest edit first."""
    rows = stored.where("manually_edited_at is not null")
    rows = rows if app is None else rows.where(F.col("app_name") == app)
    rows = rows.orderBy(F.desc("manually_edited_at"), *(c for c in ("app_name", "seller_id") if c in stored.columns))
    return rows if limit is None else rows.limit(limit)


def write_lookup(df: DataFrame, path: str, keys: list[str], rows_a_group: int = 100_000) -> None:
    """Write a table for lookups by ``keys``: ranges of keys in files, sorted, with Bloom filters of every key.

    A row group has a narrow range of the first keys, so that a lookup reads a few of them.
    """
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.block.row.count.limit", rows_a_group)
    for k in keys:
        out = out.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", rows_a_group)
    out.parquet(path)


def matching(spark: SparkSession, path: str, **equal: str) -> DataFrame:
    """Rows of a table of ``write_lookup`` whose columns equal the given values, which the scan holds against ranges and Bloom filters of row groups."""
    rows = spark.read.parquet(path)
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return rows


def lookup(spark: SparkSession, path: str, edited: bool = False, limit: int | None = None, **equal: str) -> DataFrame:
    """``matching`` rows, the last scraped first; with ``edited`` those edited by hand alone."""
    rows = matching(spark, path, **equal)
    rows = rows.where("manually_edited_at is not null") if edited else rows
    rows = rows.orderBy(F.desc("last_scraped_at"), *equal)
    return rows if limit is None else rows.limit(limit)


def edit_log(edits: DataFrame, equal: dict[str, str], limit: int = 200) -> DataFrame:
    """The latest ``limit`` edits with the given columns' values, the last first."""
    for c, v in equal.items():
        edits = edits.where(F.col(c) == v)
    return edits.orderBy(F.desc("edited_at"), *(c for c in edits.columns if c != "edited_at")).limit(limit)


def overlay_edits(rows: DataFrame, edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``rows`` with the latest edit (keys, field, value, edited_at) of each field in place."""
    last = keep_one(edits.where(F.col("field").isin(*fields)), [*keys, "field"], F.col("edited_at"), last=True)
    wide = last.groupBy(*keys).agg(*(F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"_e_{f}") for f in fields))
    out = rows.join(wide, keys, "left")
    return out.select(*(F.when(F.col(f"_e_{c}").isNotNull(), F.col(f"_e_{c}.value")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def merge_forward(current: DataFrame, prior: DataFrame, registered: DataFrame | None, app: str, touched: DataFrame | None = None) -> DataFrame:
    """This run's rows and the prior rows of registered apps it did not touch; without a registry all apps count.

    ``touched`` are the apps that the run reached, also those of which it found nothing or an
    error; without it they are those that have rows.
    """
    reached = current.select(app) if touched is None else current.select(app).unionByName(touched.select(app))
    rest = prior.join(reached.distinct(), app, "left_anti")
    rest = rest if registered is None else rest.join(registered.select(app).distinct(), app, "left_semi")
    return current.unionByName(rest, allowMissingColumns=True)


def row_count_gate(current: DataFrame, previous: DataFrame, group: str, block: float = 0.5, review: float = 0.2) -> DataFrame:
    """(group, rows, before, status): ok, pending_review or blocked by the drop of rows; without a previous run ok."""
    return row_drop_check(current, previous, [group], review, block).drop("drop")


def pagination_gate(trace: DataFrame, group: str, tolerance: float = 0.05) -> DataFrame:
    """(group, pages, scraped, reported, ok) of page traces (pos, page_num, first_key, rows, reported)."""
    sums = trace.groupBy(group).agg(F.count("*").alias("pages"), F.sum("rows").alias("scraped"), F.max("reported").alias("reported"))
    return sums.join(pagination_check(trace, group, tolerance=tolerance).select(group, (F.col("status") == "ok").alias("ok")), group)


def schema_status(found: list[str], required: list[str], optional: list[str]) -> tuple[str, list[str], list[str]]:
    """blocked with missing columns, pending_review with unknown ones, else canonical."""
    missing, extra = sorted(set(required) - set(found)), sorted(set(found) - set(required) - set(optional))
    return ("blocked" if missing else "pending_review" if extra else "canonical"), missing, extra


def promote_schema(found: list[str], required: list[str], optional: list[str]) -> list[str]:
    """The optional columns after those that were found and nobody knew are taken in, in their order."""
    return [*optional, *(c for c in dict.fromkeys(found) if c not in required and c not in optional)]


def frameworks(text: str) -> list[str]:
    """A comma-separated list in lower case without blanks and repeats; auto where nothing is left."""
    return list(dict.fromkeys(x.strip().lower() for x in text.split(",") if x.strip())) or ["auto"]


def cell_equal(a: Column, b: Column) -> Column:
    """Null, NaN and blank text are equal, and so are texts that differ in outer blanks."""
    clean = lambda c: F.nullif(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("NaN"))
    return clean(a).eqNullSafe(clean(b))


def cell_diff(current: DataFrame, previous: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, before, after) of the cells that differ; null and blank are equal."""
    long = lambda df, name: df.select(*keys, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(keys, fields, "field", name)
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return long(previous, "before").join(long(current, "after"), [*keys, "field"]).where(~clean("before").eqNullSafe(clean("after")))


def populated(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, populated, total): values that are neither null nor blank, in one pass."""
    counts = df.agg(F.count("*").alias("total"), *(F.count_if(F.trim(F.col(f).cast("string")) != "").alias(f) for f in fields))
    return counts.unpivot(["total"], fields, "field", "populated").select("field", "populated", "total")
