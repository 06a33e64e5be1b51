"""Anomaly detection of a current set of sequences against a baseline model."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelet.functions.stats import ladder
from tracelet.functions.text import growth_label
from tracelet.operators.model import Model
from tracelet.operators.predict import sequence_probability

# Severity ladders.
UNSEEN = [(0.01, "high"), (0.05, "medium")]
DRIFT = [(0.5, "critical"), (0.3, "high"), (0.15, "medium")]
SEASON = [(1.2, "critical"), (0.8, "high"), (0.4, "medium")]
EPSILON = 1e-9


@dataclasses.dataclass(frozen=True)
class Config:
    threshold: float = 0.05
    min_length: int = 2
    min_frequency: int = 10
    growth: float = 0.5
    confidence: float = 0.5
    seasonality_threshold: float = 0.3
    drift_threshold: float = 0.2
    metrics: tuple[str, ...] = ("weekday",)
    as_of: date | None = None


@dataclasses.dataclass(frozen=True)
class Context:
    """Baseline model, current distinct sequences with counts, and optional side tables."""

    baseline: Model
    current: DataFrame  # sequence, n
    history: DataFrame | None = None  # sequence, pos, label, value
    seasonality: DataFrame | None = None  # metric, bucket, p_baseline, p_current[, description]


def length(sequence: str = "sequence") -> Column:
    return F.size(F.split(sequence, " "))


def unseen(ctx: Context, cfg: Config = Config()) -> DataFrame:
    """Distinct current sequences that the baseline finds improbable."""
    p = sequence_probability(ctx.baseline, ctx.current)
    rows = ctx.current.where(length() >= cfg.min_length).join(p, "sequence").where(F.col("probability") < cfg.threshold)
    severity = F.when(F.col("probability") <= 0, "critical").otherwise(ladder(F.col("probability"), UNSEEN, "low", least=False))
    return rows.select("sequence", F.lit("unseen_sequence").alias("type"), "probability", (1 - F.col("probability")).alias("score"), severity.alias("severity"), F.col("n").alias("count"))


def patterns(ctx: Context, min_frequency: int = 5) -> DataFrame:
    """Frequent current sequences with their baseline counts and growth."""
    base = ctx.baseline.sequence_freq.select("sequence", F.col("n").alias("baseline_count"))
    rows = ctx.current.where(F.col("n") >= min_frequency).join(base, "sequence", "left").withColumn("baseline_count", F.coalesce("baseline_count", F.lit(0)))
    growth = F.when(F.col("baseline_count") == 0, 1.0).otherwise((F.col("n") - F.col("baseline_count")) / F.greatest(F.lit(1), F.col("baseline_count")))
    return rows.withColumn("growth", growth)


def trend(values: Column) -> Column:
    """Of the last three values: strictly up, strictly down, else stable."""
    last = F.slice(values, -3, 3)
    up = (last[0] < last[1]) & (last[1] < last[2])
    down = (last[0] > last[1]) & (last[1] > last[2])
    return F.when(F.size(values) < 3, "stable").when(up, "accelerating").when(down, "decelerating").otherwise("stable")


def emerging(ctx: Context, cfg: Config = Config()) -> DataFrame:
    """Frequent sequences that are new or have grown."""
    rows = patterns(ctx, cfg.min_frequency).where(~((F.col("baseline_count") > 0) & (F.col("growth") < cfg.growth)))
    today = F.lit(cfg.as_of) if cfg.as_of else F.current_date()
    if ctx.history is not None:
        h = ctx.history.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "value"))).alias("h"))
        rows = rows.join(h, "sequence", "left")
    else:
        rows = rows.withColumn("h", F.lit(None).cast("array<struct<pos:int,label:string,value:double>>"))
    values = F.coalesce(F.transform("h", lambda x: x["value"]), F.array().cast("array<double>"))
    first = F.try_element_at("h", F.lit(1))["label"]
    days = first.try_cast("int")
    seen = F.when(first.isNull(), today).when(days.isNotNull(), F.date_sub(today, days)).otherwise(first.try_cast("date"))
    confidence = F.greatest(F.lit(cfg.confidence), F.least(F.lit(1.0), F.round(1 - F.exp(-F.abs("growth")), 4)))
    return rows.select(
        "sequence", F.lit("emerging_pattern").alias("type"), F.col("n").alias("count"), "baseline_count", "growth", growth_label(F.col("growth")).alias("growth_label"),
        confidence.alias("confidence"), trend(values).alias("trend"), seen.cast("string").alias("first_seen"), F.when(F.size("h") > 0, F.size(F.filter(values, lambda v: v > 0))).alias("days_active"),
    )


def kl_divergence(profile: DataFrame) -> DataFrame:
    """(metric, divergence) of current from baseline over the buckets of both; missing ones count as EPSILON."""
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(EPSILON)) for c in ("p_baseline", "p_current"))
    # terms are added up in the order of buckets, so that the sum does not depend on how rows are dealt
    terms = profile.select("metric", "bucket", (p * F.ln(p / q)).alias("term"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "term"))), lambda x: x["term"])
    return terms.groupBy("metric").agg(F.greatest(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)).alias("divergence"))


def seasonality(ctx: Context, cfg: Config = Config()) -> DataFrame:
    """Metrics whose distribution over buckets has moved."""
    if ctx.seasonality is None:
        raise ValueError("there is no seasonality profile")
    rows = ctx.seasonality.where(F.col("metric").isin(*cfg.metrics))
    both = rows.groupBy("metric").agg(F.count("p_baseline").alias("b"), F.count("p_current").alias("c"), *([F.first("description", True).alias("description")] if "description" in rows.columns else [])).where("b > 0 AND c > 0").drop("b", "c")
    found = kl_divergence(rows).join(both, "metric").where(F.col("divergence") >= cfg.seasonality_threshold)
    return found.select(
        F.lit("seasonality").alias("type"), F.concat("metric", F.lit("_effect")).alias("pattern"), "divergence", F.least(F.lit(1.0), F.col("divergence")).alias("significance"), ladder(F.col("divergence"), SEASON, "low").alias("severity"),
        *([F.col("description")] if "description" in found.columns else []),
    )


def mean_length(freq: DataFrame, name: str) -> DataFrame:
    return freq.agg((F.sum(length() * F.col("n")) / F.sum("n")).alias(name))


def drift(ctx: Context, cfg: Config = Config()) -> DataFrame:
    """At most one row: how much longer or shorter current sequences are on average."""
    both = mean_length(ctx.baseline.sequence_freq, "baseline_mean").join(mean_length(ctx.current, "current_mean"))  # one row each
    relative = (F.col("current_mean") - F.col("baseline_mean")) / F.col("baseline_mean")
    rows = both.where("baseline_mean > 0").withColumn("relative", relative).where(F.abs("relative") >= cfg.drift_threshold)
    told = F.concat(F.lit("Average length moved by "), growth_label(F.col("relative")))
    return rows.select(F.lit("drift").alias("type"), "baseline_mean", "current_mean", "relative", F.when(F.col("relative") >= 0, "upward").otherwise("downward").alias("direction"), ladder(F.abs("relative"), DRIFT, "low").alias("severity"), told.alias("description"))


Detector = Callable[[Context, Config], DataFrame]
DETECTORS: dict[str, Detector] = {"unseen": unseen, "emerging": emerging, "seasonality": seasonality, "drift": drift}


def register(name: str, detector: Detector) -> None:
    DETECTORS[name] = detector


class AnomalyDetector:
    """Chooses detectors and settings, then unions what they find. Every setter gives a new detector."""

    def __init__(self, ctx: Context, cfg: Config = Config(), chosen: tuple[str, ...] = (), order: str | None = None, sink: Callable[[DataFrame], None] | None = None, listener: Callable[[DataFrame], None] | None = None) -> None:
        self.ctx, self.cfg, self.chosen, self.order, self.sink, self.listener = ctx, cfg, chosen, order, sink, listener

    def _with(self, *names: str, **changes) -> AnomalyDetector:
        own = {k: changes.pop(k) for k in ("ctx", "order", "sink", "listener") if k in changes}
        made = AnomalyDetector(self.ctx, dataclasses.replace(self.cfg, **changes), (*self.chosen, *(n for n in names if n not in self.chosen)), self.order, self.sink, self.listener)
        for k, v in own.items():
            setattr(made, k, v)
        return made

    def unseen_sequences(self) -> AnomalyDetector:
        return self._with("unseen")

    def emerging_patterns(self) -> AnomalyDetector:
        return self._with("emerging")

    def detect_seasonality(self) -> AnomalyDetector:
        return self._with("seasonality")

    def drift(self) -> AnomalyDetector:
        return self._with("drift")

    def using(self, name: str) -> AnomalyDetector:
        return self._with(name)

    def min_length(self, n: int) -> AnomalyDetector:
        return self._with(min_length=max(1, n))

    def threshold(self, value: float) -> AnomalyDetector:
        """Also the seasonality threshold where that still has its default and the value is lower."""
        value = max(0.0, value)
        default = Config().seasonality_threshold
        lower = self.cfg.seasonality_threshold == default and value < default
        return self._with(threshold=value, **({"seasonality_threshold": value} if lower else {}))

    def seasonality_threshold(self, value: float) -> AnomalyDetector:
        return self._with(seasonality_threshold=max(0.0, value))

    def drift_threshold(self, value: float) -> AnomalyDetector:
        return self._with(drift_threshold=max(0.0, value))

    def minimum_frequency(self, n: int) -> AnomalyDetector:
        return self._with(min_frequency=max(1, n))

    def growth(self, value: float) -> AnomalyDetector:
        return self._with(growth=value)

    def confidence_level(self, value: float) -> AnomalyDetector:
        return self._with(confidence=min(1.0, max(0.0, value)))

    def metrics(self, *names: str) -> AnomalyDetector:
        return self._with(metrics=tuple(names))

    def seasonality_data(self, profile: DataFrame) -> AnomalyDetector:
        return self._with(ctx=dataclasses.replace(self.ctx, seasonality=profile))

    def order_by(self, field: str) -> AnomalyDetector:
        return self._with(order=field)

    def persisting(self, sink: Callable[[DataFrame], None]) -> AnomalyDetector:
        return self._with(sink=sink)

    def without_persistence(self) -> AnomalyDetector:
        return self._with(sink=None)

    def on_events(self, listener: Callable[[DataFrame], None]) -> AnomalyDetector:
        return self._with(listener=listener)

    def without_events(self) -> AnomalyDetector:
        return self._with(listener=None)

    def get(self, **overrides) -> DataFrame:
        """What all chosen detectors find (all four where none is chosen), as one table; numbers in descending, other fields in ascending order."""
        cfg = dataclasses.replace(self.cfg, **overrides)
        names = self.chosen or tuple(n for n in DETECTORS if n != "seasonality" or self.ctx.seasonality is not None)
        parts = [DETECTORS[n](self.ctx, cfg).withColumn("detector", F.lit(n)) for n in names]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p, allowMissingColumns=True)
        if self.order and self.order in found.columns:
            numeric = dict(found.dtypes)[self.order] not in ("string", "date", "timestamp", "boolean")
            found = found.orderBy(F.desc(self.order) if numeric else F.asc(self.order))
        if self.sink:
            self.sink(found)
        if self.listener:
            self.listener(found)
        return found


def route_alerts(found: DataFrame, channels: dict[str, str]) -> DataFrame:
    """One row (severity, channel, anomalies) for every severity that occurs and has a channel; a missing severity is ``info``."""
    severity = F.coalesce("severity", F.lit("info")) if "severity" in found.columns else F.lit("info")
    if not channels:
        return found.select(severity.alias("severity"), F.lit("").alias("channel"), F.lit(0).cast("long").alias("anomalies")).where(F.lit(False))
    wired = F.create_map(*[F.lit(x) for kv in sorted(channels.items()) for x in kv])
    rows = found.select(severity.alias("severity")).where(F.col("severity").isin(*channels))
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("anomalies")).select("severity", wired[F.col("severity")].alias("channel"), "anomalies")


class Monitor:
    """One run over all detectors with shared overrides, and what is to be alerted."""

    ALLOWED = frozenset(f.name for f in dataclasses.fields(Config))

    def __init__(self, detector: AnomalyDetector, channels: dict[str, str] | None = None, interval: str | None = None) -> None:
        self.detector, self.channels, self.interval = detector, channels or {}, interval

    def detect_anomalies(self, **settings) -> Monitor:
        known = {k: v for k, v in settings.items() if k in self.ALLOWED}
        return Monitor(self.detector._with(**known), self.channels, self.interval)

    def alerts(self, channels: dict[str, str]) -> Monitor:
        return Monitor(self.detector, channels, self.interval)

    def check_interval(self, interval: str) -> Monitor:
        return Monitor(self.detector, self.channels, interval)

    def start(self) -> dict[str, object]:
        found = self.detector.get()
        return {"anomalies": found, "alerts": route_alerts(found, self.channels), "interval": self.interval}
