"""Markov models as tables: transitions (prefix, token, cnt, probability) and sequence frequencies.

Counts are a commutative monoid, so training in parts, merging and streaming all come down to adding
counts. One shuffle deals the pairs by (prefix, token), behind partial aggregation on the map side
(the start prefix has a row for every sequence); totals of prefixes are added up from the distinct
pairs and joined back, by broadcast where they are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelet.functions.text import next_prefix, sequence_key, steps, tokenize


@dataclass(frozen=True)
class Model:
    """A trained model; ``order`` belongs to it and can't be changed afterwards."""

    order: int
    transitions: DataFrame
    sequence_freq: DataFrame

    def to_probabilities(self) -> DataFrame:
        return self.transitions


def checked_order(order: int) -> int:
    if order < 1:
        raise ValueError("the order must be at least 1")
    return order


def token_rows(corpus: DataFrame, text: str = "text") -> DataFrame:
    """A corpus of texts as token sequences."""
    return corpus.withColumn("tokens", tokenize(F.col(text)))


def step_rows(sequences: DataFrame, order: int, tokens: str = "tokens", *keep: str) -> DataFrame:
    some = sequences.where(F.size(tokens) > 0)
    return some.select(*keep, F.inline(steps(F.col(tokens), checked_order(order))))


def counts(sequences: DataFrame, order: int, tokens: str = "tokens", weight: str | None = None) -> DataFrame:
    """(prefix, token, cnt); ``weight``: how often each sequence counts."""
    rows = step_rows(sequences, order, tokens, *([weight] if weight else []))
    return rows.groupBy("prefix", "token").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("cnt"))


def with_probability(counted: DataFrame) -> DataFrame:
    """Totals of prefixes are summed map-side and joined back, so that a prefix with very many successors is never sorted in one task; a join can be split where it is skewed."""
    totals = counted.groupBy("prefix").agg(F.sum("cnt").alias("__total")).where("__total > 0")
    return counted.join(totals, "prefix").select("prefix", "token", "cnt", (F.col("cnt") / F.col("__total")).alias("probability"))


def sequence_freq(sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
    some = sequences.where(F.size(tokens) > 0)
    return some.groupBy(sequence_key(F.col(tokens)).alias("sequence")).agg(F.count(F.lit(1)).alias("n"))


def train(sequences: DataFrame, order: int = 2, tokens: str = "tokens") -> Model:
    """Empty input gives an empty model."""
    return Model(checked_order(order), with_probability(counts(sequences, order, tokens)), sequence_freq(sequences, tokens))


def train_from_frequencies(freq: DataFrame, order: int = 2) -> Model:
    """The same model from distinct sequences and their counts, without repeating any."""
    weighted = freq.withColumn("tokens", F.split("sequence", " "))
    return Model(order, with_probability(counts(weighted, order, "tokens", "n")), freq)


def merge(a: Model, b: Model) -> Model:
    """What training on both inputs together would give."""
    if a.order != b.order:
        raise ValueError("models of different order don't merge")
    pairs = a.transitions.select("prefix", "token", "cnt").unionByName(b.transitions.select("prefix", "token", "cnt"))
    freq = a.sequence_freq.unionByName(b.sequence_freq)
    return Model(a.order, with_probability(pairs.groupBy("prefix", "token").agg(F.sum("cnt").alias("cnt"))), freq.groupBy("sequence").agg(F.sum("n").alias("n")))


def cumulative(transitions: DataFrame) -> DataFrame:
    """Running probability of each prefix, tokens in ascending order."""
    w = Window.partitionBy("prefix").orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("prefix")
    # integers add up exactly in any order, so the sums are of counts
    return transitions.withColumn("cumulative", F.sum("cnt").over(w) / F.sum("cnt").over(whole))


def transition_map(transitions: DataFrame, order: int) -> DataFrame:
    """(prefix, token, next_prefix), without the end token."""
    return transitions.select("prefix", "token", next_prefix(F.col("prefix"), F.col("token"), order).alias("next_prefix")).where("next_prefix IS NOT NULL")


def metrics(model: Model) -> DataFrame:
    """One row: states, transitions, average and maximal probability, confidence, sequence counts."""
    t = model.transitions.agg(
        F.countDistinct("prefix").alias("states"),
        F.count(F.lit(1)).alias("transitions"),
        F.coalesce(F.avg("probability"), F.lit(0.0)).alias("avg_probability"),
        F.coalesce(F.max("probability"), F.lit(0.0)).alias("max_probability"),
    )
    f = model.sequence_freq.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sequence_count"),
        F.count(F.lit(1)).alias("unique_sequences"),
        F.coalesce(F.round(F.max("n") / F.sum("n"), 4), F.lit(0.0)).alias("confidence"),
    )
    return t.join(f)  # one row each
