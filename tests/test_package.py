"""The package by itself."""

from pathlib import Path

import pytest

from tracelet import testing
from tracelet.operators import model

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_corpus_operators():
    for p in (ROOT / "tracelet").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tracelet.llm" not in p.read_text(), p
    for p in (ROOT / "tests").glob("*.py"):
        if p.name != "test_package.py":
            assert "llm" not in p.read_text(), p


def test_assertions(spark):
    m = model.train(model.token_rows(spark.createDataFrame([("a b",), ("a b",), ("a c",)], "text string")), 1)
    testing.assert_model_is_sound(m)
    testing.assert_predicts(m, "a", ["b", "c"])
    testing.assert_generated_from(m, ["a b", "c"])
    with pytest.raises(AssertionError):
        testing.assert_generated_from(m, ["a z"])
