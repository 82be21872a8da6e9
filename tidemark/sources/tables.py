"""The synthetic tables in the shape of accounts, snapshots, departures and subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every figure that depends on today's date is computed as of this day.
AS_OF = "2001-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_text(balance):
    """A plan's text by account balance, with the usual blanks and sentinels."""
    bands = ((0, ""), (1500, "N/A"), (3000, "Free"), (4500, "Free Trial"), (6500, "Lite $30 Monthly"), (8500, "Standard $1,200 Yearly"))
    out = F.lit("Premium")
    for top, name in reversed(bands):
        out = F.when(balance < top, name).otherwise(out)
    return out


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer with orders: app, seller_id, country, plan, dates and counts."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("installed_d"), F.to_date(F.max("o_orderdate")).alias("last_d"), F.count("*").alias("orders"),
        F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"),
    )
    customer = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return customer.join(per, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("app"), F.col("c_custkey").alias("seller_id"), F.col("n_name").alias("country"), plan_text(F.col("c_acctbal")).alias("plan"),
        "installed_d", "last_d", "orders", "failed", "spend", F.concat(F.col("orders") % 5, F.lit("/4")).alias("steps"),
    )


def with_products(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """``accounts`` with the number of different parts in their orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = lines.groupBy(F.col("o_custkey").alias("seller_id")).agg(F.count_distinct("l_partkey").alias("products"))
    return df.join(parts, "seller_id", "left").na.fill(0, ["products"])


def snapshot(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    """Customers with an order in a half-open range of days, with that range's counts."""
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz")))
    per = rows.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_priority"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    plan = F.when(F.col("last_priority").startswith("1"), "Premium").when(F.col("last_priority").startswith("2"), "Lite").when(F.col("last_priority").startswith("3"), "Free").when(F.col("last_priority").startswith("4"), "N/A").otherwise("Trial")
    return per.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("app"), F.col("o_custkey").alias("seller_id"), plan.alias("plan"), "orders", "failed", "spend")


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as a departure log: app, seller_id, platform, left_on."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("pos"), F.concat(F.lit("app"), F.col("user_id") % 3).alias("app"), F.col("user_id").alias("seller_id"), F.concat(F.lit("p"), F.get_json_object("props", "$.k").cast("int") % 3).alias("platform"), F.col("ts").alias("left_on"))
