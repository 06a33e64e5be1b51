"""Seasonal patterns of a time series (ts, value) and a forecast with bands."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.functions.records import flatten, has, optional, paths
from tracelet.functions.text import clamp

GATE = 0.15
#: How a group is called, and in which order the patterns act.
GROUPS = {"day_of_week": "EEEE", "hour_of_day": "HH:00"}


def series(df: DataFrame, metric: str | None = None) -> DataFrame:
    """(ts, value) from ``timestamp`` or ``date``, and ``value`` or the metric; unusable rows are left out."""
    ts = F.coalesce(*[optional(df, c, "timestamp") for c in ("ts", "timestamp", "date")])
    value = F.coalesce(optional(df, "value", "double"), *([optional(df, metric, "double")] if metric else []))
    return df.select(ts.alias("ts"), value.alias("value")).where("ts IS NOT NULL AND value IS NOT NULL")


# Where a record's time and an embedded history may stand.
STAMPS = ("timestamp", "date", "created_at", "metrics.timestamp", "metrics.date", "metrics.created_at")
ANY_STAMP, ANY_HISTORY = re.compile("timestamp|date", re.IGNORECASE), re.compile("(?:history|series)$")


def found_time(df: DataFrame) -> Column:
    """The first time that a record has: under one of STAMPS, then under any name with timestamp or date in it, in the order of the fields."""
    names = [n for n in STAMPS if has(df, n) or n in df.columns]
    names += [n for n in paths(df) if ANY_STAMP.search(n) and n not in names]
    return F.coalesce(*[optional(df, n, "timestamp") for n in names], F.lit(None).cast("timestamp"))


def found_metric(df: DataFrame, metric: str) -> Column:
    """The metric of a record: under its name, under ``metrics``, then under any name that ends with it, in the order of the fields."""
    names = [metric, f"metrics.{metric}", f"metrics_{metric}"]
    names += [n for n in paths(df) if n.endswith(metric) and n not in names]
    return F.coalesce(*[optional(df, n, "double") for n in names], F.lit(None).cast("double"))


def embedded_series(df: DataFrame, metric: str) -> DataFrame:
    """Points of the records themselves and those of their embedded histories: arrays of structs, at any depth, whose name ends with history or series, with ``timestamp`` or ``date`` and the metric or ``value``."""
    flat = flatten(df)
    found = df.select(found_time(df).alias("ts"), F.coalesce(found_metric(df, metric), optional(df, "value", "double")).alias("value"))
    for f in flat.schema.fields:
        if ANY_HISTORY.search(f.name) and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            found = found.unionByName(series(flat.select(F.explode(F.col(f"`{f.name}`")).alias("p")).select("p.*"), metric))
    return found.where("ts IS NOT NULL AND value IS NOT NULL")


def fallback_series(freq: DataFrame, as_of: datetime) -> DataFrame:
    """Where there are no points: distinct sequences as one a day up to ``as_of``, their counts as values, in order of sequence."""
    from tracelet.operators.cluster import positions

    n = freq.agg(F.count(F.lit(1)).alias("m"))
    rows = positions(freq, "sequence").join(F.broadcast(n))  # one row
    return rows.select((F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.col("m") - 1 - F.col("position"))).alias("ts"), F.col("n").cast("double").alias("value"))



def group_means(points: DataFrame, kind: str) -> DataFrame:
    """(label, n, average, multiplier) of each weekday or hour."""
    rows = points.groupBy(F.date_format("ts", GROUPS[kind]).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("average"), F.var_pop("value").alias("variance"), F.sum("value").alias("total"))
    whole = points.agg(F.avg("value").alias("overall"))
    return rows.join(F.broadcast(whole)).withColumn("multiplier", F.when(F.col("overall") > 0, F.col("average") / F.col("overall")).otherwise(1.0))  # one row


def strength(groups: DataFrame) -> DataFrame:
    """One row: how much of the spread lies between the groups, 0 to 1."""
    between = F.sum(F.col("n") * F.pow(F.col("average") - F.col("overall"), 2))
    within = F.sum(F.col("variance") * F.greatest(F.lit(1), F.col("n") - 1))
    return groups.agg(between.alias("b"), within.alias("w")).select(F.when(F.col("b") + F.col("w") > 0, clamp(F.col("b") / (F.col("b") + F.col("w")))).otherwise(0.0).alias("strength"))


def details(points: DataFrame, components: Sequence[str] = (), gate: float = GATE) -> DataFrame:
    """(pattern_type, strength, label, average, multiplier) of the allowed patterns whose strength passes the gate, with the roundings that forecasts use."""
    parts = []
    for kind in GROUPS:
        if components and kind not in components:
            continue
        g = group_means(points, kind)
        parts.append(g.join(F.broadcast(strength(g))).where(F.col("strength") > gate).select(F.lit(kind).alias("pattern_type"), "strength", "label", F.round("average", 4).alias("average"), F.round("multiplier", 2).alias("multiplier")))  # strength: one row
    if not parts:
        raise ValueError("no such component")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def patterns(found: DataFrame) -> DataFrame:
    """One row (pattern_type, strength, description) for each pattern."""
    best = F.max_by("label", F.struct("average", "label"))
    worst = F.min_by("label", F.struct("average", "label"))
    top = F.array_join(F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("average", "label")))), 1, 2), lambda x: x["label"]), ", ")
    rows = found.groupBy("pattern_type").agg(F.round(F.first("strength"), 2).alias("strength"), best.alias("best"), worst.alias("worst"), (F.max("average") - F.min("average")).alias("lift"), top.alias("top"))
    day = F.format_string("%s is %.0f%% above %s", "best", F.col("lift") * 100, "worst")
    return rows.select("pattern_type", "strength", F.when(F.col("pattern_type") == "day_of_week", day).otherwise(F.concat(F.lit("Highest at "), "top")).alias("description"))


def insights(found: DataFrame) -> DataFrame:
    """(pattern_type, insight, expected_lift): peaks, and the lowest weekday."""
    peak = F.max_by(F.struct("label", "multiplier"), F.struct("average", "label"))
    low = F.min_by("label", F.struct("average", "label"))
    rows = found.groupBy("pattern_type").agg(peak.alias("p"), low.alias("l"))
    lift = F.concat(F.round((F.col("p.multiplier") - 1) * 100).cast("int").cast("string"), F.lit("%"))
    day = F.array(F.struct(F.concat(F.lit("Campaigns pay most on "), F.col("p.label")).alias("insight"), lift.alias("expected_lift")), F.struct(F.concat(F.col("l"), F.lit(" is the weakest day")).alias("insight"), F.lit(None).cast("string").alias("expected_lift")))
    hour = F.array(F.struct(F.concat(F.lit("Use peaks around "), F.col("p.label")).alias("insight"), F.lit(None).cast("string").alias("expected_lift")))
    return rows.select("pattern_type", F.inline(F.when(F.col("pattern_type") == "day_of_week", day).otherwise(hour)))


def advanced(last: Column, i: Column, window: str) -> Column:
    """The time ``i`` windows later; months clamp to their last day."""
    if window == "weekly":
        return last + F.make_dt_interval(days=i * 7)
    if window == "monthly":
        clock = last.cast("timestamp") - F.date_trunc("day", last)
        return F.add_months(last, i).cast("timestamp") + clock
    return last + F.make_dt_interval(days=i)


def forecast(points: DataFrame, window: str = "daily", horizon: int = 30, level: float = 0.95, components: Sequence[str] = ()) -> DataFrame:
    """One row for each future window: value, bands, trend and seasonal components, confidence. An empty series gives no row."""
    level, horizon = min(1.0, max(0.0, level)), max(1, horizon)
    ends = points.agg(F.avg("value").alias("base"), F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last_value"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("n"))
    days = (F.unix_micros("t1") - F.unix_micros("t0")) / 86_400_000_000
    slope = F.when(F.col("n") < 2, 0.0).otherwise((F.col("last_value") - F.col("first")) / F.greatest(F.lit(1.0), F.when(days == 0, F.col("n").cast("double")).otherwise(days)))
    rows = ends.where("n > 0").withColumn("slope", slope).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    rows = rows.withColumn("at", advanced(F.col("t1"), F.col("i"), window))
    found = details(points, components)
    by_day = found.where("pattern_type = 'day_of_week'").select(F.col("label").alias("d"), F.col("average").alias("day_average"))
    by_hour = found.where("pattern_type = 'hour_of_day'").select(F.col("label").alias("h"), F.col("multiplier").alias("hour_multiplier"))
    rows = rows.join(F.broadcast(by_day), F.date_format("at", GROUPS["day_of_week"]) == F.col("d"), "left").join(F.broadcast(by_hour), F.date_format("at", GROUPS["hour_of_day"]) == F.col("h"), "left")  # 7 and 24 rows at most
    seasonal = F.coalesce("day_average", "base") * F.coalesce("hour_multiplier", F.lit(1.0))
    line = F.col("base") + F.col("slope") * F.col("i")
    rows = rows.withColumns({"seasonal": seasonal, "line": line}).withColumn("y", F.greatest(F.lit(0.0), F.col("line") + (F.col("seasonal") - F.col("base"))))
    band = F.col("y") * (1 - level)
    name = round(level * 100)
    return rows.select(
        F.col("i").alias("step"), F.to_date("at").alias("date"), F.date_format("at", "EEEE").alias("day_of_week"), F.col("y").alias("forecasted_value"),
        F.greatest(F.lit(0.0), F.col("y") - band).alias(f"lower_bound_{name}"), (F.col("y") + band).alias(f"upper_bound_{name}"),
        F.col("line").alias("trend_component"), F.col("seasonal").alias("seasonal_component"),
        F.greatest(F.lit(0.0), level - band / F.greatest(F.lit(0.0001), F.col("y") + 0.0001)).alias("confidence"),
    ).orderBy("step")


def rounded(made: DataFrame) -> DataFrame:
    """The forecast as it is shown: four places, confidence two."""
    numbers = [c for c, k in made.dtypes if k == "double"]
    return made.withColumns({c: F.round(c, 2 if c == "confidence" else 4) for c in numbers})
