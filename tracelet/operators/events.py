"""What an operator's result gives notice of, as rows (event, subject, summary): to be appended, streamed or sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows(found: DataFrame, event: str, subject: Column, summary: Column) -> DataFrame:
    return found.select(F.lit(event).alias("event"), subject.cast("string").alias("subject"), summary.alias("summary"))


def anomalies(found: DataFrame) -> DataFrame:
    """Of a detector's findings: patterns that emerged, and anomalies of all other kinds; a missing severity is info."""
    has = lambda n: F.col(n) if n in found.columns else F.lit(None).cast("string")
    subject = F.coalesce(has("sequence"), has("pattern"), F.col("type"))
    emerged = F.col("type") == "emerging_pattern"
    told = F.when(emerged, F.concat(subject, F.lit(" grew by "), F.coalesce(has("growth_label"), F.lit("an unknown share")))).otherwise(F.concat(F.lit("["), F.coalesce(has("severity"), F.lit("info")), F.lit("] "), F.col("type"), F.lit(": "), subject))
    return found.select(F.when(emerged, "pattern_emerged").otherwise("anomaly_detected").alias("event"), subject.alias("subject"), told.alias("summary"))


def cluster_shift(shift: DataFrame) -> DataFrame:
    """One event where clusters have shifted."""
    return rows(shift.where("shifted"), "cluster_shifted", F.lit("clusters"), F.concat(F.col("baseline_clusters").cast("string"), F.lit(" clusters before, "), F.col("current_clusters").cast("string"), F.lit(" now")))


def churn_risk(scored: DataFrame) -> DataFrame:
    """Customers whose level is called high."""
    return rows(scored.where("risk_level = 'high'"), "churn_risk_identified", F.col("customer_id"), F.concat(F.lit("score "), F.round("score", 2).cast("string")))


def high_ltv(valued: DataFrame, first_segment: str = "high") -> DataFrame:
    return rows(valued.where(F.col("segment") == first_segment), "high_ltv_customer_identified", F.col("customer_id"), F.concat(F.lit("value "), F.round("ltv_score", 2).cast("string")))


def recommendations(actions: DataFrame) -> DataFrame:
    return rows(actions, "recommendation_generated", F.col("customer_id"), F.concat(F.col("recommended_action"), F.lit(" by "), F.col("channel")))


def forecast_ready(made: DataFrame) -> DataFrame:
    """One event where there is a forecast."""
    whole = made.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b")).where("n > 0")
    return rows(whole, "seasonal_forecast_ready", F.lit("forecast"), F.concat(F.col("n").cast("string"), F.lit(" points, "), F.col("a").cast("string"), F.lit(" to "), F.col("b").cast("string")))


def model_trained(measured: DataFrame, key: str) -> DataFrame:
    return rows(measured, "model_trained", F.lit(key), F.concat(F.col("states").cast("string"), F.lit(" states, "), F.col("transitions").cast("string"), F.lit(" transitions")))


def content_generated(texts: DataFrame) -> DataFrame:
    return rows(texts, "content_generated", F.col("walk"), F.col("text"))


def prediction_made(predictions: DataFrame) -> DataFrame:
    return rows(predictions.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), "prediction_made", F.col("seed"), F.concat(F.col("n").cast("string"), F.lit(" predictions")))
