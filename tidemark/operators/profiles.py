"""Profiles of accounts by a classifier that the caller brings; its results are cached."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.store import profiles_to_make, upsert_profiles

FIELDS = ("business_type", "categories", "insight")
_SCHEMA = "business_type string, categories array<string>, insight string, source string"


def unknown(texts: pd.Series) -> pd.DataFrame:
    """The default classifier: it knows nothing, and so needs no service."""
    return pd.DataFrame({"business_type": ["Unknown"] * len(texts), "categories": [[] for _ in texts], "insight": [""] * len(texts)})


def classified(df: DataFrame, keys: list[str], text: str, classify: Callable[[pd.Series], pd.DataFrame] = unknown) -> DataFrame:
    """(keys, fields, source) of each row by ``classify``, a batch of texts at a time.

    Null texts are blank. A batch that fails gives rows with source ``error`` and nulls.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = classify(batch[text].fillna(""))[list(FIELDS)].assign(source="model")
            except Exception:
                found = pd.DataFrame({**{f: [None] * len(batch) for f in FIELDS}, "source": "error"})
            yield pd.concat([batch[keys].reset_index(drop=True), found.reset_index(drop=True)], axis=1)

    return df.select(*keys, text).mapInPandas(run, f"{kinds}, {_SCHEMA}")


def enriched(df: DataFrame, cache: DataFrame, keys: list[str], text: str, now: str, classify: Callable[[pd.Series], pd.DataFrame] = unknown, days: int = 30) -> DataFrame:
    """The cache (keys, fields, source, cached_at) after rows without a fresh profile were classified; errors are not cached."""
    made = classified(profiles_to_make(df, cache, keys, now, days), keys, text, classify).where("source <> 'error'")
    return upsert_profiles(cache, made.withColumn("cached_at", F.lit(now).cast("timestamp_ntz")), keys)
