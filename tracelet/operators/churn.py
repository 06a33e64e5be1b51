"""Churn scores of customers, their causes and what to do."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelet.functions.records import optional
from tracelet.functions.text import clamp, let

LEVELS = {"high": 0.70, "medium": 0.40}
FEATURES = 12


# The score's parts, and when inactivity and support contacts count in full; names of the actions.
SHARES = {"days": 0.40, "trend": 0.30, "adoption": 0.20, "tickets": 0.10}
IDLE_DAYS, MANY_TICKETS = 60, 5
EMAIL, OUTREACH, CALL = "send_engagement_email", "priority_support_outreach", "schedule_success_call"


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def risk_level(score: Column, levels: dict[str, float]) -> Column:
    """The highest threshold that is reached; else low."""
    made = F.lit("low")
    for name, bound in sorted(levels.items(), key=lambda x: x[1]):
        made = F.when(score >= bound, name).otherwise(made)
    return made


def fallback_customers(freq: DataFrame) -> DataFrame:
    """Stand-ins for customers where there are none: one for each distinct sequence."""
    return freq.select(
        F.substring(F.sha2("sequence", 256), 1, 12).alias("customer_id"),
        F.greatest(F.lit(0), 30 - F.col("n")).alias("days_since_last_login"),
        F.when(F.col("n") > 1, "growing").otherwise("declining").alias("usage_trend"),
        F.least(F.lit(1.0), F.octet_length("sequence") / 120).alias("feature_adoption_rate"),
        F.greatest(F.lit(0), F.round(F.col("n") / 2).cast("int")).alias("support_tickets"),
    )


def churn(records: DataFrame, as_of: datetime | None = None, features: Sequence[str] = (), levels: dict[str, float] | None = None, recommendations: bool = False, total_features: int = FEATURES, digits: int | None = 2) -> DataFrame:
    """(customer_id, score, risk_level, factors[, actions]), highest scores first. Records lacking any of ``features`` are left out; missing columns take their defaults.

    The score adds inactivity, usage, adoption and support from left to right, so that it is the same
    to the last bit wherever it is computed.
    """
    rows = records
    for name in features:
        rows = rows.where(optional(rows, name).isNotNull())
    levels = LEVELS if levels is None else levels
    now = F.lit(as_of) if as_of else F.current_timestamp()
    login = F.coalesce(optional(rows, "last_login_at", "timestamp"), optional(rows, "activity.last_login_at", "timestamp"))
    days = F.coalesce(optional(rows, "days_since_last_login", "double"), F.abs(F.datediff(now, login)).cast("double"), F.lit(0.0))
    numeric = F.coalesce(optional(rows, "usage_trend_score", "double"), optional(rows, "analytics.usage_trend_score", "double"))
    named = F.lower(optional(rows, "usage_trend"))
    trend = F.coalesce(named, F.when(numeric >= 0.66, "growing").when(numeric <= 0.33, "declining").when(numeric.isNotNull(), "flat"), F.lit("flat"))
    breadth = F.coalesce(optional(rows, "feature_usage_breadth", "double"), optional(rows, "analytics.feature_usage_breadth", "double"))
    every = F.coalesce(optional(rows, "total_features", "double"), F.lit(float(total_features)))
    adoption = clamp(F.coalesce(optional(rows, "feature_adoption_rate", "double"), F.when(every > 0, F.least(F.lit(1.0), F.coalesce(breadth, F.lit(0.0)) / every)).otherwise(0.0)))
    tickets = F.coalesce(optional(rows, "support_tickets", "double"), optional(rows, "support_ticket_count", "double"), optional(rows, "support.open_tickets", "double"), F.lit(0.0))
    base = rows.select(F.coalesce(optional(rows, "customer_id"), optional(rows, "id"), F.lit("unknown")).alias("customer_id"), days.alias("days"), trend.alias("trend"), adoption.alias("adoption"), tickets.alias("tickets"))
    parts = base.withColumns({
        "c_days": F.lit(SHARES["days"]) * F.least(F.col("days") / IDLE_DAYS, F.lit(1.0)),
        "c_trend": F.lit(SHARES["trend"]) * F.when(F.col("trend") == "declining", 1.0).when(F.col("trend") == "growing", 0.0).otherwise(0.5),
        "c_adoption": F.lit(SHARES["adoption"]) * (1 - F.col("adoption")),
        "c_tickets": F.lit(SHARES["tickets"]) * F.least(F.col("tickets") / MANY_TICKETS, F.lit(1.0)),
    })
    scored = parts.withColumn("score", clamp(F.col("c_days") + F.col("c_trend") + F.col("c_adoption") + F.col("c_tickets")))
    scored = scored.withColumn("risk_level", risk_level(F.col("score"), levels))
    share = lambda c: F.when(F.col("score") > 0, rounded(F.col(c) / F.col("score"), digits)).otherwise(0.0)
    named_parts = (("c_days", F.concat(F.lit("no_login_"), F.col("days").cast("long").cast("string"), F.lit("_days"))), ("c_trend", F.lit("usage_trend_decline")), ("c_adoption", F.lit("feature_adoption_decline")), ("c_tickets", F.lit("support_contact_increase")))
    factors = F.array(*[F.when(F.col(c) > 0, F.struct(name.alias("factor"), share(c).alias("weight"))) for c, name in named_parts])
    out = ["customer_id", "score", "risk_level", F.array_compact(factors).alias("factors")]
    if recommendations:
        # bound once: the score is a large expression, which each action would repeat
        known = F.struct(F.col("risk_level").alias("level"), F.col("score").alias("score"), F.col("tickets").alias("tickets"))
        out.append(let(known, lambda k: actions(k["level"], k["score"], k["tickets"], digits)).alias("actions"))
    return scored.select(*out).orderBy(F.desc("score"), "customer_id")


def actions(level: Column, score: Column, tickets: Column, digits: int | None = 2) -> Column:
    """Steps against churn: (action, discount, expected_recovery_rate)."""
    high = level == "high"

    def one(when: Column, name: str, most: Column | float, more: Column | float, discount: Column | None = None) -> Column:
        most, more = (x if isinstance(x, Column) else F.lit(x) for x in (most, more))
        rate = rounded(F.least(most, score + more), digits)
        return F.when(when, F.struct(F.lit(name).alias("action"), (F.lit(None).cast("int") if discount is None else discount).alias("discount"), rate.alias("expected_recovery_rate")))

    return F.array_compact(F.array(
        one(F.lit(True), EMAIL, F.when(high, 0.6).otherwise(0.5), F.when(high, 0.25).otherwise(0.18), F.when(high, 20).otherwise(15)),
        one(high, OUTREACH, 0.7, 0.30),
        one((level != "low") & (tickets.cast("int") == 0), CALL, 0.55, 0.22),
    ))
