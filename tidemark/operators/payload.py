"""Upserts from JSON payloads whose keys nobody knows beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.snapshots import keep_one
from tidemark.operators.store import upsert_accounts


def payload_rows(payloads: DataFrame, json_col: str, keys: list[str], data: list[str], own: tuple[str, ...] = ("run_stamp",), extra: str = "extra_fields") -> DataFrame:
    """(keys, data, extra_fields) of every object in payloads of JSON arrays, as text.

    A field is the text of its value: nested values as JSON, null and missing ones as null.
    Other keys go to ``extra_fields``, a map to JSON text that is null where there are none;
    an ``extra_fields`` object of the payload itself is taken over, and its keys come first.
    Keys in ``own`` are the store's and dropped. Objects that lack one of ``keys`` leave, as do
    elements that are no object, and payloads that are no array or no JSON. Of repeated keys
    the last of a payload counts, of equal ones in several payloads any.
    """
    parsed = payloads.select(F.monotonically_increasing_id().alias("_doc"), F.try_parse_json(json_col).alias("_v"))
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key is null").select("_doc", "pos", "value")
    text = lambda c: F.try_variant_get("value", f"$['{c}']", "string")
    every = F.try_variant_get("value", "$", "map<string,variant>")
    known = [*keys, *data, *own, extra]
    rest = F.map_filter(every, lambda k, _: ~k.isin(*known))
    held = F.coalesce(F.try_variant_get("value", f"$['{extra}']", "map<string,variant>"), F.map_filter(every, lambda k, _: F.lit(False)))
    fresh = F.map_filter(rest, lambda k, _: ~F.map_contains_key(held, k))
    extras = F.transform_values(F.map_concat(held, fresh), lambda _, v: F.to_json(v))
    rows = each.select("_doc", "pos", *(text(c).alias(c) for c in [*keys, *data]), F.when(F.size(extras) > 0, extras).alias(extra))
    told = rows.where(" and ".join(f"coalesce(`{k}`, '') <> ''" for k in keys))
    return keep_one(told, keys, F.col("_doc"), F.col("pos"), last=True).select(*keys, *data, extra)


def upsert_payload(stored: DataFrame, payloads: DataFrame, json_col: str, keys: list[str], data: list[str], scraped_at: str, integers: tuple[str, ...] = ()) -> DataFrame:
    """``upsert_accounts`` of ``stored`` with the objects of JSON payloads; ``extra_fields`` is a column of both.

    Cells that are no integers are null and cost no other cell.
    """
    rows = payload_rows(payloads, json_col, keys, data).withColumn("scraped_at", F.lit(scraped_at).cast("timestamp_ntz"))
    return upsert_accounts(stored, rows, keys, [*data, "extra_fields"], integers)
