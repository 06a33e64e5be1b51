import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end"

#: Nulls in every column, empty and blank texts, a very long one, repeated rows, one id with two texts.
ODD = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 1),
    (2, "the CAT sat on the mat and looked at the dog.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "fr", "b", 0),
    (5, " \n\t ", None, "b", 4),
    (6, LONG, "en", None, None),
    (7, "ÉCOLE d'été", "fr", "a", 9),
    (7, "école d'été", "fr", "a", 9),
    (8, "one two three", "en", "a", 3),
    (8, "one two three", "en", "a", 3),
    (None, "one two three", "en", "a", 3),
    (None, None, None, None, None),
    (9, "12 34 -- !!", "de", "a", 3),
    (10, "漢字 🙂 ▁ x  y", "de", "c", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def crowded(odd):
    """The odd rows with columns that are called like outputs and helpers."""
    names = ("fp", "root", "component_id", "score", "lang_pred", "predicted", "keep_id", "kept", "group_size", "text_sha256", "n_words", "hit_words", "hit_items", "piece_ids", "decoded", "secrets", "t", "id", "rows", "sha", "host", "n", "h")
    return odd.withColumns({n: F.lit("mine") for n in names})


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """A folder of tables with odd rows."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "sat on the mat and"), (2, None), (None, "two three"), (3, "!!")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, None, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "HTTP://WWW.Example.COM/en/a?b", "x"), (2, None, None), (None, "no mark", ""), (3, "", None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (2, None, None, "<|im_end|>\\"), (None, 5, "assistant", "b"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
