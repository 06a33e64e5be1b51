"""The shared plumbing: lookups of hot keys, samples, text maps."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.llm import common, exact_dedup, language, pieces, simhash


def test_lookup_of_hot_and_cold_keys(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") < 3000, 7).when(F.col("id") < 5000, F.col("id") % 50 + 100).otherwise(F.col("id")).alias("k"))
    right = left.where("k <> 107").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    got = common.lookup(left, right, "k", "n", 6000).collect()
    assert len(got) == 6000 and {r["id"] for r in got} == set(range(6000))
    assert all(r["v"] == (None if r["k"] == 107 else r["k"] * 2) for r in got)
    assert {r["n"] for r in got if r["k"] == 7} == {3000}


def test_samples_are_bounded_and_the_same(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(None, "x", "common"), (5000, None, "rare"), (5001, "y", None), (5002, "z" * 90, "rare")], "doc_id long, text string, lang string"))
    a = common.labelled_sample(docs, docs, "doc_id", "text", "lang", F.lit(True), 40, 50)
    b = common.labelled_sample(docs.repartition(7), docs.repartition(3), "doc_id", "text", "lang", F.lit(True), 40, 50)
    assert a == b
    by = {y: [t for t, z in a if z == y] for y in ("rare", "common")}
    assert len(by["common"]) == 40 and 38 <= len(by["rare"]) <= 40 and all(len(t) <= 50 for t, _ in a)
    assert common.labelled_sample(docs, docs, "doc_id", "text", "lang", F.lit(False), 40, 50) == []
    with pytest.raises(ValueError):
        common.labelled_sample(docs, docs, "doc_id", "text", "text", F.lit(True), 1, 50)


def test_more_labels_than_share_the_rows(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 90).alias("lang"))
    made = common.labelled_sample(docs, docs, "doc_id", "text", "lang", F.lit(True), 40, 50, 100, 180)
    assert len(made) == 180 and len({y for _, y in made}) == 90
    model = language.learn(docs, F.lit(True))
    assert len(model.labels) == 90
    assert {r["lang_pred"] for r in language.identify(docs.limit(20), model).collect()} <= set(model.labels)


def test_text_maps_keep_columns_and_order_of_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "é" * (i % 5), {"a": i}) for i in range(200)] + [(None, None, None)], "i long, `odd name` string, m map<string,int>")
    out = [("i", T.IntegerType(), pa.int32())]
    got = common.map_text(rows, "odd name", out, lambda texts: ([None if t is None else len(t) for t in texts],))
    assert got.columns == ["odd name", "m", "i"]
    assert all(r["i"] == (None if r["odd name"] is None else 2 * len(r["odd name"])) for r in got.collect())
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 100] * 1000)], names=["t"])
    monkeypatch.setattr(common, "SLICE_BYTES", 1000)
    parts = list(common.slices(batch, 0))
    assert len(parts) > 50 and sum(p.num_rows for p in parts) == 1000


def test_batches_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.get_total_buffer_size()])], names=["rows", "bytes"])

    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("text "), 1000).alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    common.map_text(rows, "text", [("n", T.LongType(), pa.int64())], lambda texts: ([len(t) for t in texts],))
    got = rows.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 4000 and max(r["bytes"] for r in got) < 6 << 20
    one = spark.range(0, 3, 1, 1).select(F.repeat(F.lit("text "), 2_000_000).alias("text"))
    lengths = common.map_text(one, "text", [("n", T.LongType(), pa.int64())], lambda texts: ([len(t) for t in texts],), []).collect()
    assert [r["n"] for r in lengths] == [10_000_000] * 3
    spark.conf.set(key, str(64 << 20))  # the session's own choice stands
    common.map_text(rows, "text", [("n", T.LongType(), pa.int64())], lambda texts: ([len(t) for t in texts],))
    assert spark.conf.get(key) == str(64 << 20)
    spark.conf.unset(key)


def test_workers_forget_other_operators_tables(spark, monkeypatch):
    begun = []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema, *_: begun.append(fn) or spark.createDataFrame([], schema))
    pieces.encode(docs)
    exact_dedup.owners(docs)
    simhash.fingerprinted(docs)
    own, *others = begun
    assert len(others) == 3
    for fn in others:
        pieces.tables(pieces.model_path())
        list(own(iter([])))
        assert pieces._loaded
        list(fn(iter([])))
        assert not pieces._loaded
