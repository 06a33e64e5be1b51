"""Inputs of the registered queries, derived from the driver's tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelet.sources.readers import sessions

# Where baseline and current events part, and the day on which customers are judged.
SPLIT, AS_OF, YEAR_BEFORE, TWO_YEARS_BEFORE = "2024-01-20", date(2001, 8, 1), date(2000, 8, 1), date(1999, 8, 1)
NOW = datetime(2001, 8, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).where(F.col("session") < SPLIT)


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).where(F.col("session") >= SPLIT)


def money(column: str):
    """Prices have two decimals; sums of decimals are exact in any order."""
    return F.col(column).cast("decimal(18,2)")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer records with the fields that predictors read, of customers who have ordered; others have none of these fields, and no record."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), money("o_totalprice").alias("p"), "o_orderpriority", "o_orderstatus")
    window = lambda a, b: F.coalesce(F.sum(F.when((F.col("d") >= F.lit(a)) & (F.col("d") < F.lit(b)), F.col("p"))), F.lit(0).cast("decimal(28,2)"))
    by = orders.groupBy("o_custkey").agg(
        F.datediff(F.lit(AS_OF), F.max("d")).alias("days_since_last_login"),
        F.datediff(F.lit(AS_OF), F.min("d")).alias("days_since_signup"),
        window(YEAR_BEFORE, date(9999, 1, 1)).alias("late"),
        window(TWO_YEARS_BEFORE, YEAR_BEFORE).alias("early"),
        F.countDistinct("o_orderpriority").alias("priorities"),
        F.countDistinct("o_orderstatus").alias("statuses"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("support_tickets"),
        F.min_by(F.col("p"), F.struct("d", "o_orderkey")).cast("double").alias("first_purchase_value"),
        (F.sum("p").cast("double") / F.count(F.lit(1))).alias("average_order_value"),
        F.count(F.lit(1)).alias("orders"),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").join(by, F.col("c_custkey") == F.col("o_custkey"))
    trend = F.when(F.col("late") < F.col("early"), "declining").when(F.col("late") > F.col("early"), "growing").otherwise("flat")
    return rows.select(
        F.col("c_custkey").cast("string").alias("customer_id"), "days_since_last_login", trend.alias("usage_trend"), (F.col("priorities") / 5).alias("feature_adoption_rate"), "support_tickets", "days_since_signup",
        "first_purchase_value", "average_order_value", (F.col("late").cast("double") / 12).alias("mrr"), F.least(F.lit(1.0), F.col("orders") / 20).alias("engagement_score"),
        F.least(F.greatest(F.col("c_acctbal") / 10000, F.lit(0.0)), F.lit(1.0)).alias("referral_probability"), (F.col("priorities") + F.col("statuses")).cast("double").alias("features_used"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their last event and journey, for recommending."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return rows.select(F.col("user_id").cast("string").alias("customer_id"), F.element_at("e", -1)["event_type"].alias("last_action"), F.array_join(F.transform("e", lambda x: x["event_type"]), " ").alias("journey_sequence"))


def seasonality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, bucket, p_baseline, p_current) of weekday or weekend, and of the hour."""
    e = table(spark, sf_dir, "events").select("ts", (F.col("ts") < F.lit(SPLIT).cast("timestamp")).alias("old"))
    weekday = F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday")
    both = e.select("old", F.inline(F.array(F.struct(F.lit("weekday").alias("metric"), weekday.alias("bucket")), F.struct(F.lit("hour").alias("metric"), F.date_format("ts", "HH").alias("bucket")))))
    counted = both.groupBy("metric", "bucket").agg(F.count(F.when(F.col("old"), 1)).alias("b"), F.count(F.when(~F.col("old"), 1)).alias("c"))
    w = Window.partitionBy("metric")
    share = lambda c: F.when(F.col(c) > 0, F.col(c) / F.sum(c).over(w))
    return counted.select("metric", "bucket", share("b").alias("p_baseline"), share("c").alias("p_current"))


def daily_revenue(spark: SparkSession, sf_dir: str, weekend: int = 1) -> DataFrame:
    """Revenue of each day, times ``weekend`` on Saturdays and Sundays."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))
    return o.select(F.col("d").cast("timestamp").alias("ts"), (F.col("v") * F.when(F.weekday("d") >= 5, weekend).otherwise(1)).alias("value"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
