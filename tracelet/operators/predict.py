"""Next-step prediction for any number of seeds at once, and the likelihood of whole sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelet.functions.text import seed_prefix, start_prefix
from tracelet.operators.model import Model, step_rows
from tracelet.schema import END


def predict(model: Model, seeds: DataFrame, seed: str = "seed", limit: int = 3) -> DataFrame:
    """(seed, prefix, rank, token, probability): the likeliest next tokens of every seed.

    A seed whose prefix the model does not know falls back to the start. The end token is no
    prediction, and the others' probabilities stay as they are. Ties go to the smaller token. The
    ``limit`` best of each prefix are ranked once, however many seeds share it, so a hot prefix costs
    one row for each of its seeds and prediction. What follows the start is one row, which is broadcast;
    seeds that begin there (blank ones) are dealt evenly instead of meeting it in one task.
    """
    begin = start_prefix(model.order)
    best = Window.partitionBy("prefix").orderBy(F.desc("probability"), "token")
    ranked = model.transitions.where(F.col("token") != END).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(0, limit))
    tops = ranked.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "probability"))).alias("tops"))
    # a prefix that only leads to the end is known, and has no predictions
    known = model.transitions.select("prefix").distinct().join(tops, "prefix", "left").withColumn("known", F.lit(True))
    start = known.where(F.col("prefix") == begin).select(F.col("tops").alias("start_tops"))
    asked = seeds.select(F.col(seed).alias("seed"), seed_prefix(F.col(seed), model.order).alias("prefix"))
    asked = asked.withColumn("place", F.when(F.col("prefix") == begin, 1 + F.monotonically_increasing_id() % 4096).otherwise(0))
    # 0 for every prefix, though not to be seen to be: a constant would leave the key
    known = known.withColumn("place", F.least(F.length("prefix"), F.lit(0)).cast("long"))
    found = asked.join(known, ["prefix", "place"], "left").join(F.broadcast(start), how="left")  # start: at most one row
    chosen = found.select("seed", F.when(F.col("known"), F.col("prefix")).otherwise(begin).alias("prefix"), F.when(F.col("known"), F.col("tops")).otherwise(F.col("start_tops")).alias("tops"))
    return chosen.select("seed", "prefix", F.inline("tops"))


def navigation(predictions: DataFrame, **filters) -> DataFrame:
    """Predictions as paths with a confidence in percent; date range and label are echoed, as filters that the model can't apply."""
    echoed = [F.lit(filters.get(k)).cast("string").alias(f"filter_{k}") for k in ("from", "to", "label")]
    return predictions.select("seed", "prefix", "rank", F.col("token").alias("path"), "probability", (F.col("probability") * 100).alias("confidence"), *echoed)


def sequence_probability(model: Model, sequences: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(sequence, probability) of distinct sequences: the product over all steps, the one to the end included; zero where a step was never seen."""
    keyed = sequences.select(F.col(sequence).alias("sequence")).distinct().withColumn("tokens", F.split("sequence", " "))
    rows = step_rows(keyed, model.order, "tokens", "sequence")
    met = rows.join(model.transitions.select("prefix", "token", "probability"), ["prefix", "token"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("probability", F.lit(0.0)).alias("p"))))
    return met.groupBy("sequence").agg(F.aggregate(ordered, F.lit(1.0), lambda a, x: a * x["p"]).alias("probability"))
