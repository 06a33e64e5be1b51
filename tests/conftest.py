import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")),
    }
    made = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def agrees(spark, duck):
    """Whether a query and its SQL give the same rows on the smallest tables."""

    def check(fn, sql):
        df = fn(spark, SF)
        cols = sorted(df.columns)
        answer = duck.sql(sql)
        assert sorted(answer.columns) == cols
        at = [answer.columns.index(c) for c in cols]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
        want = sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=key)
        assert got == want

    return check
