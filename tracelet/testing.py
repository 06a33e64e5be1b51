"""Assertions for tests of code that uses the library."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from tracelet.operators.model import Model
from tracelet.operators.predict import predict


def assert_model_is_sound(model: Model, tolerance: float = 1e-9) -> None:
    """Probabilities of every prefix sum to one."""
    off = model.transitions.groupBy("prefix").agg(F.sum("probability").alias("p")).where(F.abs(F.col("p") - 1) > tolerance)
    assert off.isEmpty(), off.limit(5).collect()


def assert_predicts(model: Model, seed: str, tokens: Iterable[str], limit: int = 3) -> None:
    """The likeliest next tokens of a seed are these, in order."""
    rows = predict(model, model.transitions.sparkSession.createDataFrame([(seed,)], "seed string"), limit=limit).orderBy("rank").collect()
    assert [r["token"] for r in rows] == list(tokens)


def assert_generated_from(model: Model, texts: Iterable[str]) -> None:
    """All tokens of the texts are tokens of the model."""
    known = {r["token"] for r in model.transitions.where(F.col("token").isin(sorted({t for x in texts for t in x.split()}))).select("token").distinct().collect()}
    missing = {t for x in texts for t in x.split()} - known
    assert not missing, missing
