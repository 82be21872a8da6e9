"""Breakdowns, segments and lead rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import BUCKETS, count_bucket
from tidemark.functions.text import label


def breakdown(df: DataFrame, group: str, dimension: str, total: str = "all_apps") -> DataFrame:
    """(group, label, n, coverage_pct) for each group and recomputed over all of them.

    Coverage is the share of a group's rows with a told label.
    """
    rows = df.select(group, label(F.col(dimension)).alias("label")).groupBy(group, "label").agg(F.count("*").alias("n"))
    both = rows.unionByName(rows.groupBy("label").agg(F.sum("n").alias("n")).withColumn(group, F.lit(total)))
    # an aggregate and a join: the labels of all groups together are not held in one task
    told = F.sum(F.when(F.col("label") != "(not set)", F.col("n")).otherwise(0))
    share = both.groupBy(group).agg((100.0 * told / F.sum("n")).alias("coverage_pct"))
    return both.join(share, group)


def bucket_counts(df: DataFrame, group: str, count_col: str) -> DataFrame:
    """(group, bucket, n) with zeros kept; negative counts are in no bucket."""
    marks = [F.count_if(count_bucket(F.col(count_col)) == b).alias(b) for b in BUCKETS]
    return df.groupBy(group).agg(*marks).unpivot([group], list(BUCKETS), "bucket", "n")


def activity(df: DataFrame, group: str, orders: str = "orders", failed: str = "failed") -> DataFrame:
    o, f = F.col(orders), F.col(failed)
    return df.groupBy(group).agg(
        F.count_if(o == 0).alias("zero"), F.count_if(o > 0).alias("active"), F.count_if(f > 0).alias("with_failed"),
        F.sum(o).alias("orders"), F.sum(f).alias("failed"), F.count("*").alias("total"),
    )


def class_counts(df: DataFrame, group: str, kind: Column, kinds: list[str]) -> DataFrame:
    """A column of counts for each kind, by group."""
    return df.withColumn("_k", kind).groupBy(group).agg(*(F.count_if(F.col("_k") == k).alias(k.lower().replace(" ", "_")) for k in kinds), F.count("*").alias("total"))


def lead_rules(df: DataFrame) -> DataFrame:
    """(seller_id, rule) for each of the overlapping rules that hold (columns paid, days, orders, products, failed, steps)."""
    free, ratio = ~F.col("paid"), F.coalesce(F.try_divide("failed", "orders"), F.lit(0.0))
    rules = {
        "priority": free & (F.col("days") >= 60) & ((F.col("orders") > 0) | (F.col("products") > 0) | (F.col("steps") >= 1)),
        "free_with_orders": free & (F.col("orders") > 0),
        "heavy_catalogue": free & (F.col("products") >= 500),
        "upsell": F.col("paid") & (F.col("orders") >= 200),
        "churn_risk": (F.col("failed") >= 10) | ((F.col("orders") > 0) & (ratio >= 0.1)),
    }
    held = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return df.select("seller_id", F.explode(held).alias("rule"))


def top_labels(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def product_activity(df: DataFrame, group: str, products: str = "products", total: str = "all_apps") -> DataFrame:
    """zero, active, total and the sum of products by group and over all of them."""
    n = F.col(products)
    rows = df.groupBy(group).agg(F.count_if(n == 0).alias("zero"), F.count_if(n > 0).alias("active"), F.sum(n).alias("products"), F.count("*").alias("total"))
    return with_sums(rows, group, total)


def with_sums(rows: DataFrame, group: str, total: str = "all_apps") -> DataFrame:
    """``rows`` and a row of the sums of all other columns."""
    return rows.unionByName(rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns if c != group)).withColumn(group, F.lit(total)))


def activity_by_class(df: DataFrame, group: str, kind: Column, total: str = "all_apps") -> DataFrame:
    """(group, plan_class, active, zero, total, orders, products) of each group and of all; the class ``all`` has the grand totals."""
    base = df.select(group, kind.alias("plan_class"), "orders", "products").groupBy(group, "plan_class").agg(
        F.count_if(F.col("orders") > 0).alias("active"), F.count_if(F.col("orders") == 0).alias("zero"), F.count("*").alias("total"), F.sum("orders").alias("orders"), F.sum("products").alias("products")
    )
    sums = [F.sum(c).alias(c) for c in ("active", "zero", "total", "orders", "products")]
    every = base.unionByName(base.groupBy("plan_class").agg(*sums).withColumn(group, F.lit(total)))
    return every.unionByName(every.groupBy(group).agg(*sums).withColumn("plan_class", F.lit("all")))


def top_by_group(df: DataFrame, group: str, column: str, k: int, total: str = "all_apps") -> DataFrame:
    """(group, value, n): of the ``k`` values most frequent over all groups, the counts of each group and of all."""
    counts = df.groupBy(group, column).agg(F.count("*").alias("n"))
    every = counts.groupBy(column).agg(F.sum("n").alias("n"))
    top = every.orderBy(F.desc("n"), column).limit(k)
    return counts.join(F.broadcast(top.select(column)), column).select(group, column, "n").unionByName(top.select(F.lit(total).alias(group), column, "n"))
