"""Recurring revenue, cohorts, renewals, concentration and plan flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import truncate

BANDS = ((0, 7), (8, 14), (15, 30), (31, 60), (61, 90))


def money(c: str):
    """Sums of money are exact: decimals inside, a double at the end."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def mrr_by_tier(df: DataFrame) -> DataFrame:
    """Installed and paying rows (tier, mrr): priced rows and their revenue by tier; rows without a price are counted apart."""
    paying = df.where("installed and paying").withColumn("tier", F.when(F.trim(F.coalesce("tier", F.lit(""))) == "", "Unknown tier").otherwise(F.col("tier")))
    priced = F.col("mrr") > 0
    out = paying.withColumn("priced_mrr", F.when(priced, F.col("mrr")).otherwise(0.0)).groupBy("tier").agg(
        F.count("*").alias("sellers"), F.count_if(~priced).alias("unpriced"), money("priced_mrr").alias("mrr")
    )
    return out.withColumn("arr", F.col("mrr") * 12)


def movement(installs: DataFrame, departures: DataFrame, install_col: str, departure_col: str) -> DataFrame:
    """(month, new, churned, net) over the months of either side."""
    a = installs.where(F.col(install_col).isNotNull()).groupBy(F.date_format(install_col, "yyyy-MM").alias("month")).agg(F.count("*").alias("new"))
    b = departures.where(F.col(departure_col).isNotNull()).groupBy(F.date_format(departure_col, "yyyy-MM").alias("month")).agg(F.count("*").alias("churned"))
    both = a.join(b, "month", "full_outer").na.fill(0, ["new", "churned"])
    return both.withColumn("net", F.col("new") - F.col("churned"))


def cohorts(df: DataFrame) -> DataFrame:
    """(month, installs, ever_paid, still_paid, pct) by install month."""
    out = df.where("installed_d is not null").groupBy(F.date_format("installed_d", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("installs"), F.count_if("ever_paid").alias("ever_paid"), F.count_if(F.col("installed") & F.col("paying")).alias("still_paid")
    )
    return out.withColumn("ever_paid_pct", F.round(100.0 * F.col("ever_paid") / F.col("installs"), 1)).withColumn("still_paid_pct", F.round(100.0 * F.col("still_paid") / F.col("installs"), 1))


def renewals(df: DataFrame) -> DataFrame:
    """(band, sellers, mrr) of paying rows by days to expiration; bands without rows are kept, later ones are not listed."""
    band = F.coalesce(*(F.when(F.col("days_to_expiration").between(a, z), F.lit(f"{a}-{z}")) for a, z in BANDS))
    counted = df.where("installed and paying").withColumn("band", band).where("band is not null").groupBy("band").agg(F.count("*").alias("sellers"), money("mrr").alias("mrr"))
    names = df.sparkSession.createDataFrame([(f"{a}-{z}",) for a, z in BANDS], "band string")
    return names.join(counted, "band", "left").select("band", F.coalesce("sellers", F.lit(0)).alias("sellers"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"))


def renewal_totals(df: DataFrame) -> DataFrame:
    """(sellers, mrr, expired): paying rows whose license ends within the bands, and those of which it has ended."""
    last = BANDS[-1][1]
    within = F.col("days_to_expiration").between(0, last)
    paying = df.where("installed and paying")
    return paying.agg(F.count_if(within).alias("sellers"), F.coalesce(money_if("mrr", within), F.lit(0.0)).alias("mrr"), F.count_if(F.col("days_to_expiration") < 0).alias("expired"))


def money_if(c: str, when: Column):
    return F.sum(F.when(when, F.col(c).cast("decimal(18,2)"))).cast("double")


def dense_score_bands(df: DataFrame, score: str) -> DataFrame:
    """``score_bands`` with all ten bands, and their names."""
    names = df.sparkSession.range(10).select(F.col("id").cast("int").alias("band")).withColumn("name", F.concat(F.when(F.col("band") == 0, 0).otherwise(F.col("band") * 10 + 1).cast("string"), F.lit("-"), (F.col("band") * 10 + 10).cast("string")))
    return names.join(score_bands(df, score), "band", "left").select("band", "name", F.coalesce("sellers", F.lit(0)).alias("sellers"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"))


def shown_flows(flows: DataFrame, length: int = 30) -> DataFrame:
    """Flows with labels cut for display."""
    return flows.withColumns({c: truncate(F.col(c), length) for c in ("source", "target")})


def score_bands(df: DataFrame, score: str) -> DataFrame:
    """Ten bands of a 0 to 100 score; the first is 0-10 and has eleven values."""
    at = F.greatest(F.lit(0), F.ceil(F.col(score) / 10).cast("int") - 1)
    return df.groupBy(at.alias("band")).agg(F.count("*").alias("sellers"), money("mrr").alias("mrr"))


def failure_by_segment(df: DataFrame, segment: str, least_sellers: int = 10, least_orders: int = 200) -> DataFrame:
    name = F.when(F.trim(F.coalesce(F.col(segment), F.lit(""))) == "", "(unset)").otherwise(F.col(segment))
    out = df.groupBy(name.alias("segment")).agg(F.count("*").alias("sellers"), F.sum("orders").alias("orders"), F.sum("failed").alias("failed"))
    return out.where((F.col("sellers") >= least_sellers) & (F.col("orders") >= least_orders)).withColumn("failure_rate", F.col("failed").cast("double") / F.col("orders"))


def top_flows(steps: DataFrame, top: int = 20) -> DataFrame:
    """(source, target, n): the most frequent of the steps (source, target) between different plans."""
    return steps.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "target").limit(top)


def plan_flows(df: DataFrame, history: str, top: int = 20) -> DataFrame:
    """(source, target, n): the most frequent steps of plan histories (text with bars), repeats in a row removed."""
    steps = F.filter(F.transform(F.split(F.coalesce(F.col(history), F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    rows = df.select(steps.alias("s")).where(F.size("s") > 1)
    rows = rows.select(F.explode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("source"), F.slice("s", F.lit(2), F.size("s") - 1).alias("target"))).alias("x")).select("x.source", "x.target")
    return top_flows(rows, top)


def concentration(df: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """(top_pct, rows, share): the share of the total that the top rows have.

    No row has a rank: equal values are counted, and of a value as many rows are taken as the
    larger ones leave. Values are told apart by bands on a logarithmic scale, so a task counts
    up the values of one band, each once however many rows have it, and the bands are few.
    """
    values = df.where(F.col(value) > 0).select(F.col(value).cast("decimal(18,2)").alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    values = values.withColumn("band", -F.floor(64 * F.log(F.col("v").cast("double"))))
    above = Window.rowsBetween(Window.unboundedPreceding, -1)
    bands = values.groupBy("band").agg(F.sum("c").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(above.orderBy("band")), F.lit(0)))
    within = F.coalesce(F.sum("c").over(above.partitionBy("band").orderBy(F.desc("v"))), F.lit(0))
    ranked = values.withColumn("within", within).join(F.broadcast(bands.select("band", "base")), "band").select("v", "c", (F.col("base") + F.col("within")).alias("before"))
    total = values.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("all"))
    cuts = F.explode(F.array(*(F.struct(F.lit(int(round(100 * p))).alias("top_pct"), F.greatest(F.lit(1), F.rint(F.col("n") * p).cast("long")).alias("rows")) for p in shares))).alias("c")
    wide = total.select("all", cuts).select("all", "c.*")
    taken = F.least("c", F.col("rows") - F.col("before"))
    return ranked.join(F.broadcast(wide), F.col("before") < F.col("rows")).groupBy("top_pct", "rows").agg(F.round(F.sum(F.col("v") * taken).cast("double") / F.first("all").cast("double"), 4).alias("share"))


def top_payers(df: DataFrame, key: str, value: str, top: int = 50) -> DataFrame:
    """(rank, key, value, share): the ``top`` rows by value, with their shares of the total."""
    rows = df.where(F.col(value) > 0).select(key, F.col(value).cast("decimal(18,2)").alias("v"))
    total = rows.agg(F.sum("v").alias("all"))
    first = rows.orderBy(F.desc("v"), key).limit(top)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("v"), key)))
    return ranked.crossJoin(F.broadcast(total)).select("rank", key, F.col("v").cast("double").alias(value), F.round(F.col("v").cast("double") / F.col("all").cast("double"), 4).alias("share"))
