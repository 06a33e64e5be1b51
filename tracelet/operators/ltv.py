"""Lifetime value: scores, segments by percentile, comparison within a segment, actions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelet.functions.records import optional
from tracelet.functions.text import clamp, currency_label
from tracelet.operators.cluster import quantiles, running_before

SEGMENTS = ("high", "medium", "at_risk")
# Churn, monthly revenue and chance of expansion of a segment whose customers don't tell theirs; and of any other segment.
USUAL = {"high": (0.08, 89.0, 0.56), "medium": (0.18, 54.0, 0.32)}
USUAL_ELSE = (0.31, 32.0, 0.18)
# Actions by segment, with the plan or programme that they offer, their usual gain and chance.
UPSELL, PLAN, UPSELL_GAIN, UPSELL_CHANCE = "upsell_premium_tier", "professional", 1200, 0.48
INVITE, PROGRAM, INVITE_GAIN, INVITE_LEAST, INVITE_CHANCE = "invite_to_success_program", "executive_briefing", 450, 300.0, 0.36


def eligible(records: DataFrame, first_days: int, as_of: datetime | None = None) -> DataFrame:
    """Records within the first days: by days since signup, else days to the first purchase, else taken as fitting; zero means the age of the account."""
    age = F.abs(F.datediff(F.lit(as_of) if as_of else F.current_timestamp(), optional(records, "created_at", "timestamp"))).cast("double")
    days = F.coalesce(optional(records, "days_since_signup", "double"), optional(records, "days_to_first_purchase", "double"), F.lit(float(first_days)))
    known = F.when(days == 0, F.coalesce(age, F.lit(0.0))).otherwise(days)
    return records.withColumn("__days", known).where(F.col("__days") <= first_days)


def scores(records: DataFrame, first_days: int = 7, as_of: datetime | None = None) -> DataFrame:
    """The eligible records with ltv_score and confidence; missing fields take their defaults."""
    rows = eligible(records, first_days, as_of)
    value = lambda default, *names: F.coalesce(*[optional(rows, n, "double") for n in names], F.lit(float(default)))
    initial = value(100, "first_purchase_value", "initial_purchase_value")
    base = rows.withColumns({"__e": clamp(value(0.6, "engagement_score")), "__f": value(6, "features_used"), "__r": clamp(value(0.2, "referral_probability")), "__i": initial})
    base = base.withColumn("__aov", F.coalesce(optional(rows, "average_order_value", "double"), F.greatest(F.col("__i"), F.lit(80.0))))
    d, e = F.col("__days"), F.col("__e")
    speed = F.when(d <= first_days, 1.8).otherwise(F.greatest(F.lit(1.0), 1.2 - d / 90))
    breadth = 1 + F.least(F.col("__f") / 12, F.lit(1.5))
    score = F.greatest(F.lit(120.0), F.col("__aov") * (1 + e)) * speed * breadth * (1 + 0.8 * e) * (1 + 0.5 * F.col("__r"))
    confidence = clamp(0.55 + 0.35 * e + F.least(F.lit(0.1), breadth / 20) - F.least(F.lit(0.15), d / 120))
    named = base.withColumns({"ltv_score": score, "confidence": confidence})
    return named.drop("__days", "__e", "__f", "__r", "__i", "__aov")


def thresholds(scored: DataFrame, segments: Sequence[str] = SEGMENTS) -> DataFrame:
    """One row with a column t0, t1, ... for all segments but the last."""
    n = len(segments)
    if n < 2:
        return scored.sparkSession.range(1).select(F.lit(0.0).alias("t"))
    return quantiles(scored, "ltv_score", **{f"t{i}": 100 - (i + 1) * 100 / n for i in range(n - 1)})


def segmented(scored: DataFrame, segments: Sequence[str] = SEGMENTS) -> DataFrame:
    """Append the first segment whose threshold the score reaches, else the last one."""
    made = F.lit(segments[-1])
    for i in range(len(segments) - 2, -1, -1):
        made = F.when(F.col("ltv_score") >= F.col(f"t{i}"), segments[i]).otherwise(made)
    t = thresholds(scored, segments)
    return scored.join(F.broadcast(t)).withColumn("segment", made).drop(*t.columns)  # one row


def segment_stats(rows: DataFrame) -> DataFrame:
    """Churn (else what retention leaves), monthly revenue, chance of expansion and score, averaged; what a customer lacks is what its segment usually has."""
    some = lambda *names: [optional(rows, n, "double") for n in names]
    usual = lambda at: F.coalesce(*[F.when(F.col("segment") == name, values[at]) for name, values in USUAL.items()], F.lit(USUAL_ELSE[at]))
    retention = optional(rows, "retention_rate", "double")
    return rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.coalesce(*some("churn_rate"), 1 - retention, usual(0))).alias("avg_churn_rate"),
        F.avg(F.coalesce(*some("mrr", "revenue.mrr"), usual(1))).alias("avg_mrr"),
        F.avg(F.coalesce(*some("expansion_probability", "upsell_likelihood"), usual(2))).alias("avg_expansion"),
        F.avg("ltv_score").alias("avg_ltv"),
    )


def characterised(rows: DataFrame) -> DataFrame:
    """Append segment_characteristics: the averages of the customer's segment as they are shown."""
    stats = segment_stats(rows)
    shown = F.struct(
        F.round(clamp(F.col("avg_churn_rate")), 2).alias("typical_churn_rate"), F.round("avg_mrr", 2).alias("average_mrr"),
        F.round(clamp(F.col("avg_expansion")), 2).alias("expansion_probability"), F.round("avg_ltv", 2).alias("average_ltv"),
    )
    return rows.join(F.broadcast(stats.select("segment", shown.alias("segment_characteristics"))), "segment")  # a row for each segment


def cohort(rows: DataFrame) -> DataFrame:
    """Append how each score stands among all: its percentile (1 for a single one), and the differences from mean and median.

    The percentile is the share of smaller scores. Distinct scores are counted, their running sum is
    taken over ranges of scores, and each row looks its score up; no task sees all rows.
    """
    distinct = rows.groupBy("ltv_score").agg(F.count(F.lit(1)).alias("__c"))
    below = running_before(distinct, "__c", "ltv_score", name="__below")
    whole = rows.agg(F.count(F.lit(1)).alias("__n"), F.avg("ltv_score").alias("__mean")).join(quantiles(rows, "ltv_score", __median=50))
    met = rows.join(below.select("ltv_score", "__below"), "ltv_score").join(F.broadcast(whole))  # whole: one row
    share = F.when(F.col("__n") > 1, F.col("__below") / (F.col("__n") - 1)).otherwise(1.0)
    return met.withColumns({"ltv_percentile": share, "vs_average": F.col("ltv_score") - F.col("__mean"), "vs_median": F.col("ltv_score") - F.col("__median")}).drop("__c", "__below", "__n", "__mean", "__median")


def labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"ltv_percentile": F.round(clamp(F.col("ltv_percentile")), 2), "vs_average_segment": currency_label(F.col("vs_average")), "vs_median_segment": currency_label(F.col("vs_median"))})


def actions(rows: DataFrame, segments: Sequence[str] = SEGMENTS) -> Column:
    """An upsell for the first segment, a success programme for all but the last."""
    value = lambda name, default: F.coalesce(optional(rows, name, "double"), F.lit(float(default)))
    plan = optional(rows, "current_plan")

    none = F.lit(None).cast("string")

    def one(when: Column, name: str, own: Column, offered: Column, program: Column, gain: Column, chance: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("action"), own.alias("current_plan"), offered.alias("recommended_plan"), program.alias("program"), F.round(gain, 2).alias("estimated_ltv_increase"), clamp(chance).alias("success_probability")))

    return F.array_compact(F.array(
        one(F.col("segment") == segments[0], UPSELL, plan, F.lit(PLAN), none, value("estimated_upsell_value", UPSELL_GAIN), value("upsell_success_probability", UPSELL_CHANCE)),
        one(F.col("segment") != segments[-1], INVITE, none, none, F.lit(PROGRAM), F.greatest(F.lit(INVITE_LEAST), value("program_value", INVITE_GAIN)), value("program_success_probability", INVITE_CHANCE)),
    ))


def ltv(records: DataFrame, first_days: int = 7, segments: Sequence[str] = SEGMENTS, historical: bool = False, as_of: datetime | None = None) -> DataFrame:
    """Customers with score, confidence, segment, its characteristics and actions, highest first; ``historical`` adds the comparison."""
    rows = characterised(segmented(scores(records, first_days, as_of), segments))
    rows = rows.withColumn("actions", actions(rows, segments))
    if historical:
        rows = labelled(cohort(rows))
    return rows.withColumn("ltv_score", F.round("ltv_score", 2)).orderBy(F.desc("ltv_score"))
