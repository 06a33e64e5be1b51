"""Exact small cases, limits and invariants of the operators."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelet.functions import stats, text
from tracelet.operators import churn, cluster, detect, events, forecast, generate, ltv, model, nba, predict, rank, report
from tracelet.operators.schedule import next_cron, next_run


def rows(spark, *texts):
    return model.token_rows(spark.createDataFrame([(t,) for t in texts], "text string"))


def frame(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# ------------------------------------------------ text
def test_tokens(spark):
    got = spark.createDataFrame([("a\n b\t c　d",), ("",), (None,), ("x __END__ y",)], "t string").select(text.tokenize(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in got] == [["a", "b", "c", "d"], [], [], ["x", "\\__END__", "y"]]


def test_labels(spark):
    df = spark.createDataFrame([(0.5, 3, 8, -1234.5), (-0.254, 0, 0, 7.0)], "g double, c int, t int, v double")
    got = df.select(text.growth_label(F.col("g")), text.percentage_label(F.col("c"), F.col("t")), text.currency_label(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("+50%", "37.5%", "-$1,235"), ("-25%", "0.0%", "+$7")]
    assert [text.format_bytes(x) for x in (0, 1023, 1024, 1536 * 1024)] == ["0 B", "1023 B", "1 KB", "1.5 MB"]


@pytest.mark.parametrize(("by", "want"), [("segment:1", ["b", "docs", "only", "unknown", "x"]), ("domain", ["a", "h.org", "only", "unknown", "x"]), ("prefix", ["a", "https:", "only", "unknown", "x"]), (lambda c: F.substring(c, 1, 1), ["a", "h", "o", "unknown", "x"])])
def test_group_keys(spark, by, want):
    ids = spark.createDataFrame([("a > b",), ("https://h.org/docs",), ("only",), (" ",), ("x",)], "i string")
    got = sorted(r[0] for r in ids.select(text.group_key(F.col("i"), by)).collect())
    assert got == (want if by != "segment:1" else ["b", "h.org", "only", "unknown", "x"])


def test_statistics(spark):
    df = spark.createDataFrame([("1",), ("2",), ("4",), ("x",), (None,)], "v string")
    v = F.col("v")
    got = df.agg(stats.mean(v), stats.variance(v), stats.median(v), stats.percentile(v, 25), stats.total(v)).first()
    assert tuple(got) == (7 / 3, pytest.approx(14 / 9), 2.0, 1.5, 7.0)
    assert tuple(df.limit(0).agg(stats.mean(v), stats.variance(v), stats.median(v)).first()) == (0.0, 0.0, 0.0)


# ------------------------------------------------ models
def test_transitions(spark):
    m = model.train(rows(spark, "a b", "a c", "", None), 1)
    assert frame(m.transitions) == [("__START__", "a", 2, 1.0), ("a", "b", 1, 0.5), ("a", "c", 1, 0.5), ("b", "__END__", 1, 1.0), ("c", "__END__", 1, 1.0)]
    assert frame(m.sequence_freq) == [("a b", 1), ("a c", 1)]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_invariants(spark, k):
    m = model.train(rows(spark, "a b a c", "b a", "a", "a b a c"), k)
    assert all(abs(r["p"] - 1) < 1e-12 for r in m.transitions.groupBy("prefix").agg(F.sum("probability").alias("p")).collect())
    assert frame(model.train_from_frequencies(m.sequence_freq, k).transitions) == frame(m.transitions)
    parts = model.merge(model.train(rows(spark, "a b a c", "b a"), k), model.train(rows(spark, "a", "a b a c"), k))
    assert frame(parts.transitions) == frame(m.transitions) and frame(parts.sequence_freq) == frame(m.sequence_freq)
    top = model.cumulative(m.transitions).groupBy("prefix").agg(F.max("cumulative").alias("c")).collect()
    assert all(r["c"] == 1.0 for r in top)


def test_empty_model(spark):
    m = model.train(rows(spark), 2)
    assert m.transitions.count() == 0 and model.metrics(m).first()["states"] == 0
    assert predict.predict(m, spark.createDataFrame([("a",)], "seed string")).count() == 0
    with pytest.raises(ValueError):
        model.train(rows(spark, "a"), 0)
    with pytest.raises(ValueError):
        model.merge(m, model.train(rows(spark, "a"), 1))


def test_predictions(spark):
    m = model.train(rows(spark, "a b", "a b", "a c", "z"), 2)
    seeds = spark.createDataFrame([("a",), ("nothing",), (None,), ("a b",)], "seed string")
    got = {(r["seed"], r["rank"]): (r["token"], r["probability"]) for r in predict.predict(m, seeds, limit=2).collect()}
    assert got == {("a", 1): ("b", 2 / 3), ("a", 2): ("c", 1 / 3), ("nothing", 1): ("a", 0.75), ("nothing", 2): ("z", 0.25), (None, 1): ("a", 0.75), (None, 2): ("z", 0.25)}  # behind "a b" comes only the end
    assert predict.predict(m, seeds, limit=0).count() == 0
    assert events.prediction_made(predict.predict(m, seeds)).count() == 3 and events.model_trained(model.metrics(m), "k").count() == 1


def test_probabilities(spark):
    m = model.train(rows(spark, "a b", "a b", "a c", "d"), 1)
    s = spark.createDataFrame([("a b",), ("d",), ("b a",)], "sequence string")
    assert {r["sequence"]: r["probability"] for r in predict.sequence_probability(m, s).collect()} == {"a b": pytest.approx(0.75 * 2 / 3), "d": 0.25, "b a": 0.0}


def test_walks(spark):
    m = model.train(rows(spark, "a b c"), 2)
    starts = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "zzz")], "walk long, s string")
    got = {r["walk"]: r["tokens"] for r in generate.walks(m, starts, 9, start="s").collect()}
    assert got == {1: ["b", "c"], 2: ["c"], 3: ["a", "b", "c"]}  # seed tokens are not emitted
    assert {r["text"] for r in generate.as_json(generate.walks(m, starts.where("walk = 1"), 1, start="s")).collect()} == {'["b"]'}
    assert generate.walks(m, starts, 0, start="s").first()["tokens"] == []
    big = model.train(rows(spark, "a b", "a c", "a d"), 1)
    many = generate.walks(big, spark.range(600).withColumnRenamed("id", "walk"), 3)
    shares = {tuple(r["tokens"]): r["count"] for r in many.groupBy("tokens").count().collect()}
    assert set(shares) == {("a", "b"), ("a", "c"), ("a", "d")} and all(140 < n < 260 for n in shares.values())


# ------------------------------------------------ detection
@pytest.fixture(scope="module")
def ctx(spark):
    base = model.train(rows(spark, "home search", "home search", "home cart pay", "help"), 2)
    now = model.sequence_freq(rows(spark, *["home cart pay"] * 2, *["odd way out"] * 3, "home search", "help"))
    return detect.Context(base, now)


def test_unseen(ctx):
    got = {r["sequence"]: r for r in detect.unseen(ctx).collect()}
    assert set(got) == {"odd way out"}
    assert (got["odd way out"]["severity"], got["odd way out"]["score"], got["odd way out"]["count"]) == ("critical", 1.0, 3)


def test_emerging(spark, ctx):
    history = spark.createDataFrame([("odd way out", i, str(d), float(d)) for i, d in enumerate((1, 2, 5))], "sequence string, pos int, label string, value double")
    cfg = detect.Config(min_frequency=2, as_of=date(2024, 5, 3))
    got = {r["sequence"]: r for r in detect.emerging(detect.Context(ctx.baseline, ctx.current, history), cfg).collect()}
    assert set(got) == {"home cart pay", "odd way out"}
    r = got["odd way out"]
    assert (r["trend"], r["first_seen"], r["days_active"], r["growth_label"], r["confidence"]) == ("accelerating", "2024-05-02", 3, "+100%", 0.6321)
    assert (got["home cart pay"]["trend"], got["home cart pay"]["first_seen"], got["home cart pay"]["days_active"]) == ("stable", "2024-05-03", None)


def test_seasonality(spark, ctx):
    p = spark.createDataFrame([("weekday", "week", 0.6, 0.3), ("weekday", "end", 0.4, 0.7), ("same", "a", 1.0, 1.0), ("half", "a", 1.0, None)], "metric string, bucket string, p_baseline double, p_current double")
    c = detect.Context(ctx.baseline, ctx.current, None, p)
    cfg = detect.Config(seasonality_threshold=0.1, metrics=("weekday", "same", "half"))
    (r,) = detect.seasonality(c, cfg).collect()
    assert r["pattern"] == "weekday_effect" and r["divergence"] == pytest.approx(0.192, abs=1e-3) and r["severity"] == "low"


def test_detector(ctx):
    d = detect.AnomalyDetector(ctx).unseen_sequences().drift().threshold(0.2).min_length(0)
    assert d.cfg.min_length == 1 and d.cfg.seasonality_threshold == 0.2
    seen = []
    found = d.persisting(seen.append).order_by("score").get(drift_threshold=0.0)
    assert seen == [found] and {r["detector"] for r in found.collect()} == {"unseen", "drift"}
    alerts = detect.route_alerts(found, {"critical": "pager", "info": "log"})
    assert frame(alerts) == [("critical", "pager", 1)]
    assert detect.route_alerts(found, {}).count() == 0
    assert {(r["event"], r["subject"]) for r in events.anomalies(found).collect()} == {("anomaly_detected", "odd way out"), ("anomaly_detected", "drift")}
    assert events.anomalies(detect.emerging(ctx, detect.Config(min_frequency=2))).where("event = 'pattern_emerged'").count() == 2
    watch = detect.Monitor(d).detect_anomalies(threshold=0.0, unknown=1).check_interval("5 minutes")
    assert watch.detector.cfg.threshold == 0.0 and watch.interval == "5 minutes"


# ------------------------------------------------ clusters and ranks
def test_clusters(spark):
    freq = spark.createDataFrame([("a", 12), ("b c", 5), ("c d e", 1), ("d", 2)], "sequence string, n long")
    assert frame(cluster.round_robin(freq, 3), "sequence", "cluster_id") == [("a", 1), ("b c", 2), ("c d e", 3), ("d", 1)]
    assert frame(cluster.assign(freq, "dbscan"), "sequence", "cluster_id") == [("a", 1), ("b c", 2), ("c d e", 3), ("d", 3)]
    p = cluster.profiles(cluster.frequency_band(freq))
    assert frame(p, "cluster_id", "profile", "size", "percentage", "favorite_path") == [(1, "power_users", 1, "25.0%", "a"), (2, "quick_browsers", 1, "25.0%", "b c"), (3, "quick_browsers", 2, "50.0%", "d")]
    assert tuple(cluster.shift(p, p).first()) == (3, 3, False)
    assert tuple(cluster.shift(p, p.where("cluster_id < 3")).first()) == (3, 2, True)
    assert events.cluster_shift(cluster.shift(p, p)).count() == 0 and events.cluster_shift(cluster.shift(p, p.limit(0))).count() == 1
    assert cluster.assign(freq, "kmeans_ml", 2).select("cluster_id").distinct().count() == 2


def test_positions_and_running_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"))
    assert all(r["position"] == r["v"] for r in cluster.positions(df, "v").collect())
    assert all(r["before"] == r["v"] * (r["v"] - 1) // 2 for r in cluster.running_before(df, "v", "v").collect())


def test_pagerank(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "src string, dst string, weight double")
    one, turns, done = rank.pagerank(edges(("A", "A", 0.0)))
    assert frame(one) == [("A", pytest.approx(1.0))] and done
    graph = edges(("A", "B", 3.0), ("A", "C", 1.0), ("B", "C", 2.0), ("C", "A", 1.0), ("D", "A", -1.0))
    got, turns, done = rank.pagerank(graph, damping=0.9, threshold=1e-8)
    scores = dict(frame(got))
    assert done and set(scores) == set("ABCD") and scores["C"] > scores["B"] and sum(scores.values()) == pytest.approx(1)
    dangling, _, _ = rank.pagerank(edges(("A", "B", 1.0)), damping=7, threshold=-1)
    assert sum(r for _, r in frame(dangling)) == pytest.approx(1)
    assert rank.pagerank(edges(), None)[1:] == (0, True)
    same = rank.analyze(edges(("A", "B", 1.0), ("B", "A", 1.0)), group_by="prefix", top=1)
    assert frame(same.nodes, "node", "normalized_score", "percentile") == [("A", 50.0, 100.0)] and same.groups.count() == 1 and same.metadata["converged"]


def test_pagerank_builder(spark):
    b = rank.PageRankBuilder(model.train(rows(spark, "a b c", "a c"), 1)).top_nodes(2).max_iterations(3)
    first = b.calculate()
    assert b.result() is first and b.include_metadata(False).calculate().metadata is None
    assert b.damping_factor(0.5).last is None
    for bad in (lambda: b.damping_factor(1), lambda: b.top_nodes(0), lambda: b.max_iterations(0), lambda: b.convergence_threshold(0)):
        with pytest.raises(ValueError):
            bad()


# ------------------------------------------------ customers
def test_churn(spark):
    people = spark.createDataFrame([("h", 60, "declining", 0.0, 5), ("m", 30, "flat", 0.5, 0), ("l", 0, "growing", 1.0, 0)], "customer_id string, days_since_last_login int, usage_trend string, feature_adoption_rate double, support_tickets int")
    got = {r["customer_id"]: r for r in churn.churn(people, recommendations=True).collect()}
    assert {k: (round(r["score"], 6), r["risk_level"]) for k, r in got.items()} == {"h": (1.0, "high"), "m": (0.45, "medium"), "l": (0.0, "low")}
    assert [(a["action"], a["expected_recovery_rate"]) for a in got["h"]["actions"]] == [("send_engagement_email", 0.6), ("priority_support_outreach", 0.7)]
    assert [f["factor"] for f in got["h"]["factors"]] == ["no_login_60_days", "usage_trend_decline", "feature_adoption_decline", "support_contact_increase"]
    assert churn.churn(people.drop("support_tickets"), features=["support_tickets"]).count() == 0
    nested = spark.createDataFrame([(("2024-01-01 00:00:00",), (0.9,))], "activity struct<last_login_at:string>, analytics struct<usage_trend_score:double>")
    assert churn.churn(nested, as_of=datetime(2024, 3, 1)).first()["score"] == pytest.approx(0.4 + 0.0 + 0.2)
    assert frame(events.churn_risk(churn.churn(people))) == [("churn_risk_identified", "h", "score 1.0")]


def test_ltv(spark):
    people = spark.createDataFrame([("a", 3, 100.0, 1.0, 12.0, 1.0), ("b", 3, 100.0, 0.0, 0.0, 0.0), ("old", 400, 1.0, 1.0, 1.0, 1.0)], "customer_id string, days_since_signup int, average_order_value double, engagement_score double, features_used double, referral_probability double")
    got = {r["customer_id"]: r for r in ltv.ltv(people, 7, ("high", "low"), historical=True).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["ltv_score"] == pytest.approx(200 * 1.8 * 2 * 1.8 * 1.5) and got["b"]["ltv_score"] == pytest.approx(120 * 1.8)
    assert (got["a"]["segment"], got["a"]["ltv_percentile"], got["b"]["segment"], got["b"]["ltv_percentile"]) == ("high", 1.0, "low", 0.0)
    assert got["a"]["vs_average_segment"] == "+$864"
    assert [x["action"] for x in got["a"]["actions"]] == ["upsell_premium_tier", "invite_to_success_program"] and got["b"]["actions"] == []
    aged = spark.createDataFrame([("n", 0, "2024-01-01"), ("o", 0, "2023-01-01")], "customer_id string, days_since_signup int, created_at string")
    assert frame(ltv.scores(aged, 7, datetime(2024, 1, 5)), "customer_id") == [("n",)]


def test_next_best_action(spark):
    m = model.train(rows(spark, "login upgrade_plan", "login browse", "login browse"), 1)
    people = spark.createDataFrame([("a", "login", None, 9, None), ("b", None, "x y", None, "sms"), ("c", "", "", None, None)], "customer_id string, last_action string, journey_sequence string, preferred_contact_hour int, preferred_channel string")
    got = {(r["customer_id"], r["rank"]): r for r in nba.next_best_actions(m, people, top=2, include_context=True).collect()}
    r = got["a", 1]
    assert (r["recommended_action"], r["channel"], r["optimal_time"], r["optimal_day"], r["primary_message"]) == ("browse", "in_app", "09:00", "Wednesday", "Try Browse")
    assert got["a", 2]["action_type"] == "email" and got["a", 1]["context"]["last_action"] == "login"
    assert got["b", 1]["recommended_action"] == "login" and got["b", 1]["channel"] == "sms"  # unknown state: what comes first
    spare = nba.next_best_actions(m, people.where("customer_id = 'a'"), top=3, excluded=("browse", "upgrade_plan"))
    assert frame(spare, "recommended_action", "probability") == [(t, 0.35) for t in ("invite_to_webinar", "schedule_success_call", "view_feature_guide")]
    assert nba.for_customer(people, "none").count() == 0


# ------------------------------------------------ series, reports, schedules
def test_forecast(spark):
    day = datetime(2024, 1, 1)
    points = spark.createDataFrame([(day + timedelta(days=i), 10.0 + (30 if (day + timedelta(days=i)).weekday() >= 5 else 0)) for i in range(28)], "ts timestamp, value double")
    made = forecast.forecast(points, horizon=7, level=7).collect()
    assert len(made) == 7 and "lower_bound_100" in made[0].asDict() and made[0]["date"] == date(2024, 1, 29)
    by = {r["day_of_week"]: r["seasonal_component"] for r in made}
    assert by["Saturday"] == 40 and by["Monday"] == 10
    found = forecast.details(points)
    assert {r["pattern_type"] for r in forecast.patterns(found).collect()} == {"day_of_week"} and forecast.insights(found).count() == 2
    months = spark.createDataFrame([(datetime(2024, m, 31), float(m)) for m in (1, 3, 5, 7)], "ts timestamp, value double")
    assert [str(r["date"]) for r in forecast.forecast(months, "monthly", 2, 0.9).collect()] == ["2024-08-31", "2024-09-30"]
    assert events.forecast_ready(forecast.forecast(points, horizon=3)).first()["summary"] == "3 points, 2024-01-29 to 2024-01-31"
    assert forecast.forecast(points.limit(0)).count() == 0 and len(forecast.forecast(points, horizon=0).collect()) == 1
    raw = spark.createDataFrame([("2024-01-01", 1.0, None), ("bad", 2.0, None), (None, None, [("2024-02-01", 3.0)])], "date string, mrr double, history array<struct<timestamp:string,mrr:double>>")
    assert frame(forecast.embedded_series(raw, "mrr"), "value") == [(1.0,), (3.0,)]
    assert forecast.fallback_series(spark.createDataFrame([("a", 2), ("b", 3)], "sequence string, n long"), day).orderBy("ts").first()["ts"] == datetime(2023, 12, 31)


def test_report(spark):
    m = model.train(rows(spark, "a b", "a b", "c"), 1)
    made = report.build(m, "k", datetime(2024, 1, 1), sections=("summary", "predictions", "recommendations"))
    assert made["predictions"][0] == {"sequence": "a b", "count": 2, "probability": 0.6667} and made["recommendations"] == ["The model looks healthy."]
    assert '"states"' in report.render(made, "json") and report.render(made, "csv").startswith("section,key,value")
    assert "<table>" in report.render(made, "html") and "## Summary" in report.render(made) and "Predictions" not in report.render(made, template="executive")
    seen = []
    assert report.deliver("x", seen.append, seen.append) == 2 and seen == ["x", "x"]
    assert report.period_start(datetime(2024, 1, 8), "7d") == datetime(2024, 1, 1) and report.period_start(datetime(2024, 1, 8), "x") is None
    with pytest.raises(ValueError):
        report.render(made, "pdf")


NOW = datetime(2024, 1, 31, 10, 30, 15)


@pytest.mark.parametrize(("given", "want"), [
    (("hourly", "15"), "2024-01-31 11:15"), (("hourly", "x"), "2024-01-31 11:00"), (("daily", "10:30"), "2024-02-01 10:30"), (("daily", "23:00"), "2024-01-31 23:00"),
    (("weekly", "wed 10:00"), "2024-02-07 10:00"), (("weekly", "fri 09:00"), "2024-02-02 09:00"), (("monthly", "31 09:00"), "2024-02-29 09:00"), (("monthly", "5 09:00"), "2024-02-05 09:00"),
    (("cron", None, "*/20 * * * *"), "2024-01-31 10:40"), (("cron", None, "0 9 * * mon-fri"), "2024-02-01 09:00"), (("cron", None, "0 0 29 2 *"), "2024-02-29 00:00"), (("other", "11:00"), "2024-01-31 11:00"),
])
def test_schedules(given, want):
    assert next_run(NOW, *given) == datetime.fromisoformat(want)


def test_no_schedule():
    assert next_run(NOW, "daily", enabled=False) is None and next_cron(NOW, "61 * * * *") is None and next_cron(NOW, "0 0 30 2 *") is None and next_run(NOW, "cron") is None


def test_fallback_with_over_a_thousand_types(spark, tmp_path):
    """Every type is excluded, however many there are."""
    from tracelet.plans import catalog

    rows = spark.range(2400).select(F.col("id").alias("event_id"), (F.col("id") % 50).alias("user_id"), F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id")).alias("ts"), F.concat(F.lit("type"), F.col("id") % 1200).alias("event_type"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).unionByName(rows, allowMissingColumns=True).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["nba_fallback"](spark, str(tmp_path)).collect()
    assert len(got) == 150 and {r["recommended_action"] for r in got} == set(nba.FALLBACK)


def test_what_a_segment_usually_has(spark):
    people = spark.createDataFrame([("high", 10.0, None, None), ("medium", 10.0, 0.5, 7.0), ("at_risk", 1.0, None, None), ("other", 1.0, None, None)], "segment string, ltv_score double, retention_rate double, mrr double")
    got = {r["segment"]: (r["avg_churn_rate"], r["avg_mrr"], r["avg_expansion"]) for r in ltv.segment_stats(people).collect()}
    assert got == {"high": (0.08, 89.0, 0.56), "medium": (0.5, 7.0, 0.32), "at_risk": (0.31, 32.0, 0.18), "other": (0.31, 32.0, 0.18)}


def test_titles_of_tokens(spark):
    tokens = ["purchase", "addToCart", "view_feature_guide", "XMLPage", "go-to top", "x"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(nba.spoken(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Purchase", "Add To Cart", "View_Feature_Guide", "X M L Page", "Go-To Top", "X"]


def test_times_and_metrics_are_found_in_records(spark):
    day = "2024-01-0"
    cases = [
        ("metrics struct<date:string,sales:double>", ((f"{day}1", 3.0),)), ("created_at string, metrics_sales double", (f"{day}1", 3.0)), ("last_date_seen string, total_sales double", (f"{day}1", 3.0)),
        ("when_timestamp string, sales string", (f"{day}1", "3")), ("x struct<my_series:array<struct<date:string,value:double>>>", (([(f"{day}1", 3.0)],),)), ("sales_history array<struct<timestamp:string,sales:double>>", ([(f"{day}1", 3.0)],)),
    ]
    for schema, row in cases:
        got = forecast.embedded_series(spark.createDataFrame([row], schema), "sales").collect()
        assert [tuple(r) for r in got] == [(datetime(2024, 1, 1), 3.0)], schema
    assert forecast.embedded_series(spark.createDataFrame([("x", 1)], "a string, b int"), "sales").count() == 0


def walked_by_hand(transitions, order, walk, length, seed):
    """One walk, choice by choice."""
    import hashlib

    prefix, out = ["__START__"] * order, []
    for step in range(length):
        mine = sorted((r["token"], r["cnt"]) for r in transitions if r["prefix"] == " ".join(prefix))
        if not mine:
            break
        u = int(hashlib.md5(f"{seed}:{walk}:{step}".encode()).hexdigest()[:8], 16) / 4294967296
        total, so_far, token = sum(c for _, c in mine), 0, None
        for token, c in mine:
            so_far += c
            if u < so_far / total:
                break
        if token == "__END__":
            break
        out.append(token)
        prefix = [*prefix, token][-order:]
    return out


@pytest.mark.parametrize(("block", "small", "hot"), [(256, 4096, 512), (2, 4096, 512), (2, 0, 512), (3, 0, 4)])
def test_walks_by_any_way_are_those_by_hand(spark, monkeypatch, block, small, hot):
    """Models that are broadcast whole, and those found block by block, with hot blocks or without."""
    monkeypatch.setattr(generate, "BLOCK", block)
    monkeypatch.setattr(generate, "HOT", hot)
    m = model.train(rows(spark, *[" ".join("abcdefg"[(i * k) % 7] for k in range(1, 2 + i % 9)) for i in range(60)]), 2)
    table = m.transitions.collect()
    got = {r["walk"]: r["tokens"] for r in generate.walks(m, spark.range(30).withColumnRenamed("id", "walk"), 10, seed=3, small=small).collect()}
    assert got == {w: walked_by_hand(table, 2, w, 10, 3) for w in range(30)}


def test_walks_end_when_none_goes_on(spark):
    m = model.train(rows(spark, "a b"), 1)
    assert [r["tokens"] for r in generate.walks(m, spark.range(2).withColumnRenamed("id", "walk"), 100).collect()] == [["a", "b"]] * 2


def test_exact_quantiles_over_ranges(spark):
    values = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 9, 2, 2, 2, 7)] + [(None,)], "v double")
    got = cluster.quantiles(values, "v", a=0, b=25, c=50, d=90, e=100).first()
    assert [round(x, 9) for x in got] == [1.0, 1.75, 2.0, 7.6, 9.0]
    assert tuple(cluster.quantiles(values.limit(0), "v", a=50).first()) == (0.0,)


def test_hubs_are_dealt_to_several_places(spark, monkeypatch):
    edges = spark.createDataFrame([("h", f"n{i}", 1.0) for i in range(40)] + [(f"n{i}", "h", 2.0) for i in range(20)], "src string, dst string, weight double")
    plain = frame(rank.pagerank(edges, threshold=1e-9)[0])
    monkeypatch.setattr(rank, "HUB", 7)
    assert rank.normalize(edges)[1].where("src = 'h'").select("place").distinct().count() > 1
    assert [(i, round(r, 9)) for i, r in frame(rank.pagerank(edges, threshold=1e-9)[0])] == [(i, round(r, 9)) for i, r in plain]


def test_superseded_ranks_are_deleted(spark, monkeypatch, tmp_path):
    from tracelet.functions import staging

    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    ranks, turns, _ = rank.pagerank(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double"))
    assert turns > 3 and ranks.count() == 3 and len(list(tmp_path.glob("*/rank*"))) == 1
    table = staging.staged(ranks, "again")
    staging.discard(ranks, None, table)
    assert not list(tmp_path.glob("*/again"))


def test_blank_seeds_are_dealt_evenly(spark):
    """Seeds that begin at the start meet nothing in the join, whatever their number; the others do."""
    m = model.train(rows(spark, "a b", "a c", "a c", "b"), 1)
    many = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise("a").cast("string").alias("seed"))
    made = predict.predict(m, many, limit=1)
    got = made.groupBy("seed", "prefix", "token", "rank").agg(F.count("*").alias("n")).collect()
    assert sorted((str(r["seed"]), r["prefix"], r["token"], r["n"]) for r in got) == [("None", "__START__", "a", 2000), ("a", "a", "c", 1000)]
    joins = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftOuter" in x]
    assert any("prefix#" in x and x.count("place#") == 2 for x in joins), joins
