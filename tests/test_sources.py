"""Sources, stores, sinks, streams, the fluent face and the command line."""

import io
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelet import cli
from tracelet.functions.records import flatten, leaves, optional
from tracelet.operators import detect, model, rank, report
from tracelet.plans.chain import EngineConfig, Manager, suggestions
from tracelet.sources import readers, sinks
from tracelet.sources.store import ParquetStore, SessionStore, valid
from tracelet.streaming import live

NOW = datetime(2024, 1, 1)


def texts(df):
    return sorted(r["text"] for r in df.collect())


def seqs(spark, *lines):
    return model.token_rows(spark.createDataFrame([(x,) for x in lines], "text string"))


def test_values(spark):
    assert texts(readers.corpus_from_values(spark, {"a": ["x", 1, [None, ""]], "b": {"c": 2.5}})) == ["1", "2.5", "x"]
    assert readers.records_from_values(spark, {"a": 1}).count() == 1 and readers.records_from_values(spark, [1, {"a": 1}, "x"]).count() == 1
    assert readers.records_from_values(spark, ["x"]).count() == 0


def test_records(spark):
    df = spark.createDataFrame([(("x", ("y",)), [1, 2], None)], "a struct<b:string,c:struct<d:string>>, e array<int>, f string")
    assert flatten(df).columns == ["a.b", "a.c.d", "e", "f"] and texts(leaves(df)) == ["1", "2", "x", "y"]
    assert df.select(optional(df, "a.c.d"), optional(df, "no.such", "int"), optional(df, "a.b", "double")).first()[:] == ("y", None, None)


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a, b\n,c\n")
    (tmp_path / "j.json").write_text('{"a": {"b": "x"}, "c": [1, null]}')
    (tmp_path / "l.txt").write_text("one two\n\nthree\n")
    (tmp_path / "d.json").write_text('[["a", "b"], ["c"]]')
    (tmp_path / "p.json").write_text('["a b", "c"]')
    p = lambda n: str(tmp_path / n)
    assert texts(readers.load(spark, "csv", p("c.csv"))) == ["a", "b", "c"]
    assert texts(readers.load(spark, "json", p("j.json"))) == ["1", "x"]
    assert texts(readers.load(spark, "file", p("l.txt"))) == ["one two", "three"]
    assert texts(readers.sequences_for_detection(spark, p("d.json"))) == texts(readers.sequences_for_detection(spark, p("p.json"))) == ["a b", "c"]
    assert texts(readers.sequences_for_detection(spark, p("l.txt"))) == ["one two", "three"]
    assert texts(readers.corpus_from_api(spark, "u", lambda _: '{"a": ["b"]}')) == ["b"]
    for source, config in (("ftp", "x"), ("csv", None)):
        with pytest.raises(ValueError):
            readers.load(spark, source, config)


def test_columns_and_entities(spark):
    df = spark.createDataFrame([("a", 1), ("0", 2), (None, 3)], "x string, y int")
    df.createOrReplaceTempView("some_table")
    assert texts(readers.corpus_from_column(df, "x")) == ["a"] and texts(readers.load(spark, "table", "some_table")) == ["0", "1", "2", "3", "a"]
    models = spark.createDataFrame([("user", "1", "k")], "entity_type string, entity_id string, model_key string")
    people = spark.createDataFrame([("user", "1"), ("user", "2")], "type string, id string")
    assert readers.trained_entities(people, models).count() == 1 and readers.trained_entities(people, models, with_model=True).count() == 2
    assert texts(readers.reconstructed(spark.createDataFrame([("a b", 2)], "sequence string, n long"))) == ["a b", "a b"]


def test_store(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path))
    a, b = model.train(seqs(spark, "a b"), 1), model.train(seqs(spark, "a c"), 1)
    assert s.get("k") is None
    s.put("k", a, ttl=60, as_of=NOW, meta={"x": 1}, records=spark.range(2))
    s.snapshot("k", "first", as_of=NOW)
    s.put("k", b, ttl=60, as_of=NOW + timedelta(seconds=30))
    assert s.get("k", NOW + timedelta(seconds=40)).sequence_freq.first()["sequence"] == "a c"
    assert s.get("k", NOW + timedelta(seconds=90)) is None and s.get("k", tag="first").sequence_freq.first()["sequence"] == "a b"
    assert s.meta("k", NOW) == {} and s.records("k", NOW) is None
    with pytest.raises(ValueError):
        s.snapshot("k", "first", as_of=NOW)
    s.export(a, str(tmp_path / "out"), password="0123456789abcdef")
    line = spark.read.text(str(tmp_path / "out")).select(F.aes_decrypt(F.unbase64("value"), F.lit("0123456789abcdef")).cast("string").alias("v")).first()["v"]
    assert json.loads(line)["tokens"]
    s.forget("k")
    assert s.get("k") is None
    kept = SessionStore()
    kept.put("k", a, ttl=1, as_of=NOW)
    assert kept.get("k", NOW) is not None and kept.get("k", NOW + timedelta(seconds=2)) is None
    rows = spark.createDataFrame([(1, None), (2, NOW)], "i int, expires_at timestamp")
    assert [r["i"] for r in valid(rows, NOW).collect()] == [1]


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("unseen_sequence", "a b", 0.1, 3)], "type string, sequence string, probability double, count long")
    sinks.append_anomalies(found, str(tmp_path / "log"), "k", NOW)
    sinks.append_anomalies(found, str(tmp_path / "log"), "k", NOW)
    log = sinks.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 2 and log.first()["score"] == 0.1
    result = rank.analyze(spark.createDataFrame([("a,b", "c", 1.0)], "src string, dst string, weight double"), max_iterations=2)
    for kind in ("json", "csv"):
        sinks.export_ranks(result, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    assert sinks.rank_snapshot(result, "k", "t", NOW).count() == 2 and sinks.event_rows("e", found, NOW).first()["event"] == "e"
    sent = []
    assert sinks.notify({"a": 1}, sinks.to_webhook("u", lambda u, b: sent.append((u, b)))) == 1 and sent == [("u", b'{"a": 1}')]
    sinks.export_predictions(found, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), sep=";", header=True).count() == 1


def test_training_in_batches_is_training_at_once(spark, tmp_path):
    root, lines = str(tmp_path / "s"), ["a b c", "a c", "b"]
    for i, x in enumerate(lines):
        live.write_delta(seqs(spark, x), i, root, 2)
    live.write_delta(seqs(spark, lines[2]), 2, root, 2)  # a batch that is repeated
    want = sorted(map(tuple, model.train(seqs(spark, *lines), 2).transitions.collect()))
    assert sorted(map(tuple, live.trained(spark, root, 2).transitions.collect())) == want
    live.compact(spark, root, str(tmp_path / "c"), 2)
    assert sorted(map(tuple, live.trained(spark, str(tmp_path / "c"), 2).transitions.collect())) == want


def test_session_stream_and_monitor(spark, tmp_path):
    rows = [(i, NOW + timedelta(minutes=m), u, t) for i, (m, u, t) in enumerate([(0, 1, "a"), (5, 1, "b"), (60, 1, "c"), (1, 2, "z"), (600, 9, "late")])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    stream = live.session_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), watermark="10 minutes")
    base, seen = model.train(seqs(spark, "a b", "a b", "c"), 1), []
    live.monitor_stream(stream, base, str(tmp_path / "ck"), lambda f, a, i: seen.append(([tuple(r) for r in f.select("detector", "sequence").collect()], a.count())), channels={"critical": "x"}).awaitTermination()
    q = live.train_stream(stream, str(tmp_path / "m"), 1)
    q.awaitTermination()
    freq = {r["sequence"]: r["n"] for r in live.trained(spark, str(tmp_path / "m"), 1).sequence_freq.collect()}
    assert freq == {"a b": 1, "c": 1, "z": 1}  # the last session is still open
    assert seen


def test_sessions_by_pause(spark):
    rows = [(i, NOW + timedelta(minutes=m), 1, t) for i, (m, t) in enumerate([(0, "a"), (5, "b"), (60, "c")])]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    assert sorted(tuple(r["tokens"]) for r in readers.sessions(e, gap="30 MINUTES").collect()) == [("a", "b"), ("c",)]
    assert [r["tokens"] for r in readers.sessions(e).collect()] == [["a", "b", "c"]]


# ------------------------------------------------ fluent face
@pytest.fixture
def manager(spark, tmp_path):
    return Manager(spark, EngineConfig(order=1, storage="file", root=str(tmp_path / "models")))


def test_chain(spark, manager, tmp_path):
    c = manager.chain().train(["a b", "a b", "a c"]).save("k")
    assert c.get_order() == 1 and c.events[0][0] == "model_trained"
    assert [r["token"] for r in c.predict("a", 1).collect()] == ["b"] and "probability" not in c.with_probabilities(False).predict("a").columns
    assert manager.chain("navigation").load("k").predict("a", 1).first()["path"] == "b"
    assert c.generate(2, seed="a").first()["text"] in ("b", "c") and c.generate_sequence(2, as_array=True, seed="a").first()["text"][0] == "["
    assert c.analyze("pagerank", iterations=2).nodes.count() > 0 and c.get_last_analysis() is not None
    more = manager.chain().incremental().cache("k").train(["a c"])
    assert more.get_sequence_frequencies().agg(F.sum("n")).first()[0] == 4
    assert c.detect("k", ["x y", "a b"]).unseen_sequences().get().count() == 1
    assert set(c.cluster("k")) == {"profiles", "baseline", "shift"} and c.monitor("k").start()["alerts"].count() == 0
    assert c.generate_async(1).result().count() == 1 and c.queue(lambda x: x.get_order()).result() == 1
    assert json.loads(c.to_json())["order"] == 1 and c.when(True, lambda x: x.option("a", 1)).get_options()["a"] == 1
    c.export(str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() > 0 and c.probability_of(["a b"]).count() == 1
    for bad in (lambda: manager.chain().model(), lambda: manager.chain().load("none"), lambda: c.detect("none"), lambda: manager.analyzer("none"), lambda: c.order(0)):
        with pytest.raises(ValueError):
            bad()
    manager.extend_analyzer("mine", lambda chain, o: "mine").extend_generator("g", lambda chain, n, o: chain.walk(n, o)).extend_builder("b", lambda m: m.chain())
    assert c.analyze("mine") == "mine" and manager.chain("b").get_context() == "text" and c.generate(1, generator="g").count() == 1


def test_predictive(spark, manager):
    manager.chain().train(["login browse", "login browse", "browse pay"]).save("k")
    p = manager.predictive("k", churn={"recommendations": True}).dataset([{"customer_id": "a", "last_action": "login", "days_since_last_login": 90, "timestamp": "2024-01-01", "value": 3}])
    assert p.churn_score().first()["actions"] and p.ltv().count() == 1 and p.seasonal_forecast(horizon=2).count() == 2
    actions = p.next_best_action("a")
    assert actions.first()["recommended_action"] == "browse"
    sent = []
    assert suggestions(actions, sent.append) == 1 and sent[0]["customer_id"] == "a"
    bare = manager.predictive("k")
    assert bare.churn_score().count() == 2 and bare.seasonal_forecast(as_of=NOW, horizon=3).count() == 3


def test_detector_protocol(spark, manager):
    detect.register("mine", lambda ctx, cfg: ctx.current.select(F.lit("mine").alias("type"), "sequence"))
    try:
        c = manager.chain().train(["a b"]).save("k")
        assert c.detect("k").using("mine").get().first()["detector"] == "mine"
    finally:
        detect.DETECTORS.pop("mine")


def test_cli(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a b c\na b d\na b c\n")
    (tmp_path / "now.txt").write_text("x y z\na b c\n")
    root = ["--root", str(tmp_path / "r")]

    def run(*args):
        out = io.StringIO()
        return cli.main([*root, *args], spark, out), out.getvalue()

    code, said = run("train", "m", "--data", str(tmp_path / "l.txt"), "--tag", "v1", "--meta", "who=me", "--order", "1")
    assert code == 0 and json.loads(said)["model"] == "m:v1"
    assert run("generate", "m:v1", "--words", "3", "--seed", "a")[1].startswith("b")
    assert json.loads(run("analyze", "m:v1", "--seed", "a b", "--limit", "1")[1])["token"] == "c"
    assert run("pagerank", "m:v1", "--iterations", "2", "--top", "1", "--snapshot")[1].count("\n") == 1
    assert "x y z" in run("detect-anomalies", "m:v1", "--input", str(tmp_path / "now.txt"), "--log", str(tmp_path / "log"))[1]
    assert run("snapshot", "m:v1", "--tag", "keep", "--export", str(tmp_path / "e"))[0] == 0
    assert "runs next" in run("schedule", "train", "--frequency", "hourly", "--list")[1]
    assert "# Report" in run("report", "m:v1", "--log", str(tmp_path / "log"), "--period", "7d")[1]
    assert run("generate", "none")[0] == 1


def test_all_suggestions_are_sent(spark):
    actions = spark.range(2500).select(F.col("id").cast("string").alias("customer_id"))
    sent = []
    assert suggestions(actions, sent.append) == 2500 and len({r["customer_id"] for r in sent}) == 2500
    sent.clear()
    with pytest.raises(ValueError):
        suggestions(actions, sent.append, limit=1000)
    assert sent == [] and suggestions(actions.limit(3), sent.append, limit=3) == 3


def test_keys_have_folders_of_their_own(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path))
    a, b = model.train(seqs(spark, "a b"), 1), model.train(seqs(spark, "a c"), 1)
    s.put("x/y", a, as_of=NOW)
    s.put("x_y", b, as_of=NOW)
    assert [s.get(k, NOW).sequence_freq.first()["sequence"] for k in ("x/y", "x_y")] == ["a b", "a c"]
    s.put("x/y", b, as_of=NOW)
    assert s.get("x/y", NOW).sequence_freq.first()["sequence"] == "a c"  # stored later at the same time
    s.put("x/y", a, as_of=NOW)
    assert s.get("x/y", NOW).sequence_freq.first()["sequence"] == "a b"


def test_tagged_versions_outlive_the_model(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path))
    s.put("k", model.train(seqs(spark, "a b"), 1), as_of=NOW)
    s.snapshot("k", "first", as_of=NOW)
    s.put("k", model.train(seqs(spark, "a c"), 1), as_of=NOW + timedelta(seconds=1))
    s.forget("k")
    assert s.get("k", NOW) is None and s.get("k", NOW, tag="first").sequence_freq.first()["sequence"] == "a b"
    s.put("k", model.train(seqs(spark, "a d"), 1), as_of=NOW + timedelta(seconds=2))
    assert s.get("k", NOW).sequence_freq.first()["sequence"] == "a d"


def test_records_stay_with_a_model_of_the_session(spark):
    m = Manager(spark, EngineConfig(order=1))
    people = spark.createDataFrame([("1", "a b", 90.0, 500.0), ("2", "b a", 1.0, 20.0)], "customer_id string, text string, days_since_last_login double, first_purchase_value double")
    m.chain().train(people).save("k", note="x")
    assert m.storage().meta("k") == {"note": "x"}
    assert sorted(r["customer_id"] for r in m.predictive("k").churn_score().collect()) == ["1", "2"]
    made = m.predictive("k").ltv().collect()
    assert len(made) == 2 and made[0]["segment_characteristics"]["average_mrr"] == 89.0
    m.storage().put("bare", m.storage().get("k"))
    assert m.predictive("bare").ltv().count() == 0 and m.predictive("bare").next_best_action().count() == 0 and m.predictive("bare").churn_score().count() > 0
    m.storage().forget("k")
    assert m.storage().records("k") is None and m.storage().meta("k") is None


def test_sessions_cut_at_pauses_across_days(spark):
    """A pause is one between two events, whatever days they lie on; days without events don't matter."""
    at = [(1, "2024-01-01 23:50:00"), (1, "2024-01-02 00:10:00"), (1, "2024-01-02 09:00:00"), (1, "2024-01-05 09:00:00"), (1, "2024-01-05 09:30:00"), (2, "2024-01-02 00:00:00"), (None, "2024-01-01 00:00:00"), (None, "2024-01-03 00:00:00")]
    rows = spark.createDataFrame([(u, t, i, f"e{i}") for i, (u, t) in enumerate(at)], "user_id int, ts string, event_id int, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((str(r["user_id"]), r["session"], " ".join(r["tokens"])) for r in readers.sessions(rows, gap="1 HOUR").collect())
    assert got == [("1", "0", "e0 e1"), ("1", "1", "e2"), ("1", "2", "e3 e4"), ("2", "0", "e5"), ("None", "0", "e6"), ("None", "1", "e7")]


def test_snapshots_that_are_compressed_or_encrypted(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path))
    s.put("k", model.train(seqs(spark, *["a b c"] * 3, "a c"), 2), as_of=NOW)
    want = sorted(map(tuple, s.get("k", NOW).transitions.collect()))
    for tag, codec, password in (("plain", None, None), ("small", "gzip", None), ("secret", "gzip", "0123456789abcdef"), ("hidden", None, "0123456789abcdef")):
        s.snapshot("k", tag, tag, NOW, codec, password)
        got = s.get("k", NOW, tag, password)
        assert sorted(map(tuple, got.transitions.collect())) == want and got.order == 2 and sorted(r["n"] for r in got.sequence_freq.collect()) == [1, 3]
    rows = {r["tag"]: r for r in s.snapshots("k").collect()}
    assert [(rows[t]["compressed"], rows[t]["encrypted"]) for t in ("plain", "small", "secret", "hidden")] == [(False, False), (True, False), (True, True), (False, True)]
    assert all(r["original_size"] > 0 and r["stored_size"] > 0 for r in rows.values()) and rows["plain"]["original_size"] == rows["plain"]["stored_size"]
    with pytest.raises(ValueError):
        s.get("k", NOW, "secret")
    assert s.snapshots("none").count() == 0


def test_mail_channel():
    sent = []
    mail = sinks.to_mail("a@example.com", ["b@example.com", "c@example.com"], "Report", send=sent.append)
    assert sinks.notify({"x": 1}, mail) == 1 and report.deliver("<html>hi</html>", mail) == 1
    assert [m["To"] for m in sent] == ["b@example.com, c@example.com"] * 2
    assert json.loads(sent[0].get_content()) == {"x": 1} and sent[1].get_content_type() == "text/html"


def test_predictors_by_name(spark):
    m = Manager(spark, EngineConfig(order=1)).extend_predictor("constant", lambda p, o: p.chain.spark.range(o["n"]))
    m.chain().train(seqs(spark, "a b")).save("k")
    assert m.predictive("k").predict("constant", n=3).count() == 3 and m.predictive("k").predict("churn").count() == 1
    with pytest.raises(ValueError):
        m.predictive("k").predict("none")


def test_listings_say_when_there_are_more(spark, capsys, monkeypatch):
    monkeypatch.setattr(cli, "SHOWN", 2)
    seen = []
    cli.listed(spark.range(3), lambda r: seen.append(r["id"]), "--export")
    assert len(seen) == 2 and "--export writes all" in capsys.readouterr().err
    cli.listed(spark.range(2), seen.append, None)
    assert len(seen) == 4 and capsys.readouterr().err == ""


def test_database(spark):
    """A column of a database table, through the embedded database that comes with Spark, if it does."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:tracelet"
    rows = spark.createDataFrame([("a b",), ("",), (None,), ("c",)], "words string")
    try:
        rows.coalesce(1).write.format("jdbc").options(url=f"{url};create=true", dbtable="paths", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    except Exception as e:
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no embedded database")
        raise
    got = readers.corpus_from_jdbc(spark, f"{url};paths;words", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert texts(got) == ["a b", "c"]
    assert texts(readers.corpus_from_jdbc(spark, "main:paths:words", url=url, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")) == ["a b", "c"]
