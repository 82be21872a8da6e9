"""URL filters: a temporal join of captures with dated list entries, by DataFrame functions alone.

Entries (list, key, date, action) of a list become validity intervals: an ``add`` holds
until the key's next ``remove`` on that list. A capture asks for all keys that cover it:
its host, the host's parent domains, and each with the leading path segments. An as-of
join then finds the intervals active at fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.spans import let

#: Days of a bucket of the as-of join.
BUCKET_DAYS = 32


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*+://([^/?#]*+)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@", ""), r"\.?(?::[0-9]*)?$", "")


def lookup_keys(url: Column, segments: int | None = None) -> Column:
    """The keys that cover a URL: host and parent domains, alone and with leading path segments.

    All of these, or with ``segments``, those with that many at most.
    """
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*+://[^/?#]*+/([^?#]*+)", 1)
    domains = let(F.split(host(url), r"\."), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    paths = let(F.filter(F.split(path, "/"), lambda s: s != ""), lambda parts: F.transform(
        F.sequence(F.lit(0), F.size(parts) if segments is None else F.least(F.lit(segments), F.size(parts))), lambda i: F.concat(F.when(i > 0, F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ))
    keys = let(paths, lambda ends: F.flatten(F.transform(domains, lambda d: F.transform(ends, lambda p: F.concat(d, p)))))
    return F.array_distinct(F.filter(keys, lambda k: ~k.startswith("/") & (k != "")))


def validity(entries: DataFrame) -> DataFrame:
    """(list, key, since, until): half-open intervals of days or times; ``until`` is null while open.

    Of several entries of one list, key and date a ``remove`` wins. Entries with a null
    list, key or date, or another action than add or remove, are left out.
    """
    days = entries.where("list is not null and key is not null and date is not null and action in ('add', 'remove')").groupBy("list", "key", "date").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    by = Window.partitionBy("list", "key").orderBy("date")
    turns = days.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(0))).where("on <> was")
    return turns.withColumn("until", F.lead("date").over(by)).where("on = 1").select("list", "key", F.col("date").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", date_col: str = "fetched", id_col: str = "page_id") -> DataFrame:
    """(id, fetched, lists, keys) for every row of ``captures``: lists and keys active at its date, sorted.

    Rows with a null URL, a URL without a host, or a null date match nothing. Every input
    row gives one output row; of repeated rows each has the same result. Keys may have any
    number of path segments. Where either date has a time of day, both are compared as
    timestamps, a plain date as its midnight, and ``fetched`` is one. An empty table
    gives an empty result, and without entries nothing matches. Other columns are not
    read, whatever their names.
    """
    timed = [t for t in (captures.schema[date_col].dataType.typeName(), entries.schema["date"].dataType.typeName()) if t.startswith("timestamp")]
    kind = timed[0] if timed else "date"
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(date_col).cast(kind).alias("date"))
    # no longer paths are asked for than the entries have
    longest = entries.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    entries = entries.withColumn("date", F.col("date").cast(kind))
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)
    span = rows.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    # distinct questions, so that a hot host and repeated captures are asked once
    asked = rows.where("date is not null").select("url", "date").distinct()
    asked = asked.select("url", "date", bucket(F.col("date")).alias("bucket"), F.explode(lookup_keys(F.col("url"), longest)).alias("key"))
    intervals = validity(entries).crossJoin(F.broadcast(span)).where((F.col("since") <= F.col("hi")) & (F.col("until").isNull() | (F.col("until") > F.col("lo"))))
    last = F.least(F.coalesce("until", "hi"), F.col("hi"))
    intervals = intervals.select("list", "key", "since", "until", F.explode(F.sequence(bucket(F.greatest("since", "lo")), bucket(last))).alias("bucket"))
    active = asked.join(intervals, ["key", "bucket"]).where((F.col("since") <= F.col("date")) & (F.col("until").isNull() | (F.col("date") < F.col("until"))))
    hits = active.groupBy("url", "date").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.array_sort(F.collect_set("key")).alias("keys"))
    none = F.array().cast("array<string>")
    out = rows.alias("r").join(hits.alias("h"), (F.col("r.url") == F.col("h.url")) & (F.col("r.date") == F.col("h.date")), "left")
    return out.select(F.col("r.id").alias(id_col), F.col("r.date").alias("fetched"), F.coalesce("lists", none).alias("lists"), F.coalesce("keys", none).alias("keys"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of ``pages`` and their parent domains, by rule.

    By a number c of a key's md5, modulo 7: 0 to 2 put it on list ads, spam or malware from
    a day of 2024 on; for even c it is removed 60 days later, and added again 90 days after
    the first day where c is a multiple of 3.
    """
    h = host(F.col("url"))
    keys = pages.select(F.explode(F.array(h, F.regexp_replace(h, r"^[^.]*\.", ""))).alias("key")).where("key <> ''").distinct()
    number = F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("long")
    rows = keys.where(number % 7 < 3).select("key", number.alias("c"), F.element_at(F.array(*map(F.lit, ("ads", "spam", "malware"))), (number % 7 + 1).cast("int")).alias("list"), F.date_add(F.lit("2024-01-01").cast("date"), (number % 300).cast("int")).alias("d"))
    add = rows.select("list", "key", F.col("d").alias("date"), F.lit("add").alias("action"))
    remove = rows.where("c % 2 = 0").select("list", "key", F.date_add("d", 60).alias("date"), F.lit("remove").alias("action"))
    again = rows.where("c % 3 = 0").select("list", "key", F.date_add("d", 90).alias("date"), F.lit("add").alias("action"))
    return add.unionByName(remove).unionByName(again)
