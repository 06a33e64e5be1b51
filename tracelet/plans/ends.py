"""More registered queries: sources and sinks end to end, the fluent face, filters, insights, schedules and streams.

What a query writes goes to a folder of its own in the shared one and is read back from there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelet.functions.staging import shared_dir
from tracelet.operators import churn, detect, forecast, model, nba, predict, rank, report
from tracelet.operators.schedule import next_run
from tracelet.plans import inputs
from tracelet.plans.catalog import BASE, CHURN, CUR, DAY, DETECT, FIRST_DAYS, HOUR, HOURLY, LTV, METRICS, RANKED, REVENUE, SEQS, SPARSE, TOPS, USERS, context, groups_sql, query, seeds, six, sparse, sql_freq, sql_model, unseen_sql
from tracelet.plans.chain import EngineConfig, Manager, Predictive
from tracelet.sources import readers, sinks
from tracelet.sources.store import valid
from tracelet.streaming import live


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ends-{uuid.uuid4().hex}"


def counted(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sources
REGIONS = "SELECT CAST(r_regionkey AS VARCHAR) AS text FROM region UNION ALL SELECT r_name FROM region"


def region_records(spark, sf_dir) -> list[dict]:
    """The five regions as nested values."""
    return [{"key": r["r_regionkey"], "names": [r["r_name"], None, ""]} for r in inputs.table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]


@query(f"SELECT text, count(*) AS n FROM ({REGIONS}) GROUP BY 1")
def source_values(spark, sf_dir):
    return counted(readers.corpus_from_values(spark, region_records(spark, sf_dir)))


@query("SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region")
def source_records(spark, sf_dir):
    """Mappings become records, anything else between them is skipped."""
    made = readers.records_from_values(spark, ["no record", *region_records(spark, sf_dir), 7])
    return made.select("key", F.col("names")[0].alias("name"))


@query("SELECT text, count(*) AS n FROM (SELECT n_name AS text FROM nation UNION ALL SELECT CAST(n_regionkey AS VARCHAR) FROM nation) GROUP BY 1")
def source_table(spark, sf_dir):
    name = f"nations_{uuid.uuid4().hex}"
    inputs.table(spark, sf_dir, "nation").createOrReplaceTempView(name)
    return counted(readers.corpus_from_table(spark, name, ["n_name", "n_regionkey"]))


@query("SELECT text, count(*) AS n FROM (SELECT trim(c_name) AS text FROM customer UNION ALL SELECT CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT trim(c_mktsegment) FROM customer) WHERE text <> '' GROUP BY 1")
def source_csv(spark, sf_dir):
    where = folder(spark)
    inputs.table(spark, sf_dir, "customer").select(F.concat(F.lit("  "), "c_name").alias("a"), "c_nationkey", "c_mktsegment").write.option("ignoreLeadingWhiteSpace", False).csv(where)
    return counted(readers.load(spark, "csv", where))


@query("SELECT text, count(*) AS n FROM (SELECT n_name AS text FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation) GROUP BY 1")
def source_json(spark, sf_dir):
    where = folder(spark)
    rows = inputs.table(spark, sf_dir, "nation").select(F.struct("n_name", F.struct("n_nationkey").alias("inner")).alias("r"))
    rows.agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.text(where)  # 25 rows
    return counted(readers.load(spark, "json", where))


@query(f"SELECT text, count(*) AS n FROM ({REGIONS}) GROUP BY 1")
def source_api(spark, sf_dir):
    """Leaves of a JSON answer, from a getter that needs no network."""
    answer = json.dumps({"data": region_records(spark, sf_dir)})
    return counted(readers.corpus_from_api(spark, "https://example.com/regions", lambda url: answer))


@query("SELECT trim(url) AS text, count(*) AS n FROM pages WHERE trim(url) <> '' GROUP BY 1")
def source_lines(spark, sf_dir):
    where = folder(spark)
    inputs.table(spark, sf_dir, "pages").select(F.concat("url", F.lit(" ")).alias("value")).where("value IS NOT NULL").write.text(where)
    return counted(readers.load(spark, "file", where))


@query("SELECT c_mktsegment AS text, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('', '0') GROUP BY 1")
def source_column(spark, sf_dir):
    return counted(readers.corpus_from_column(inputs.table(spark, sf_dir, "customer"), "c_mktsegment"))


@query("SELECT string_agg(n_name, ' ' ORDER BY n_name) AS text, 1::BIGINT AS n FROM nation GROUP BY n_regionkey UNION ALL SELECT r_name, 1 FROM region")
def source_detection_input(spark, sf_dir):
    """A file with an array of arrays, and one with lines."""
    where = folder(spark)
    lists = inputs.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    lists.agg(F.to_json(F.collect_list("names")).alias("value")).coalesce(1).write.text(f"{where}/json")  # five rows
    inputs.table(spark, sf_dir, "region").select("r_name").coalesce(1).write.text(f"{where}/lines")
    return counted(readers.sequences_for_detection(spark, f"{where}/json").unionByName(readers.sequences_for_detection(spark, f"{where}/lines")))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS points, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS value FROM orders GROUP BY 1")
def series_given(spark, sf_dir):
    """Points of a table under the names that series may have; those without a number are left out."""
    o = inputs.table(spark, sf_dir, "orders")
    given = o.select(F.col("o_orderdate").alias("date"), F.col("o_totalprice").cast("string").alias("revenue")).unionByName(o.limit(9).select(F.col("o_orderdate").alias("date"), F.lit("none").alias("revenue")))
    return by_day(forecast.series(given, "revenue"))


def by_day(points: DataFrame) -> DataFrame:
    return points.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("points"), F.round(F.sum(inputs.money("value")).cast("double"), 2).alias("value"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS points, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS value FROM orders GROUP BY 1")
def series_embedded(spark, sf_dir):
    """The same points from the histories embedded in customers' records."""
    o = inputs.table(spark, sf_dir, "orders")
    records = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("revenue"))).alias("order_history"))
    return by_day(forecast.embedded_series(records, "revenue"))


@query("SELECT c_mktsegment, count(*) AS customers, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_model FROM customer GROUP BY 1")
def trained_entities(spark, sf_dir):
    """Customers of whom a model is stored (here: who have ordered), and all of them with its key."""
    c = inputs.table(spark, sf_dir, "customer").select(F.lit("customer").alias("type"), F.col("c_custkey").cast("string").alias("id"), "c_mktsegment")
    models = inputs.table(spark, sf_dir, "orders").select(F.lit("customer").alias("entity_type"), F.col("o_custkey").cast("string").alias("entity_id"), F.concat(F.lit("m-"), "o_custkey").alias("model_key"))
    every = readers.trained_entities(c, models, with_model=True).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    some = readers.trained_entities(c, models).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("with_model"))
    return every.join(some, "c_mktsegment", "left").select("c_mktsegment", "customers", F.coalesce("with_model", F.lit(0)).alias("with_model"))


# ---------------------------------------------------------------- sinks
@query(f"WITH {SEQS}, {sql_model(2)} SELECT prefix, token, probability, sum(cnt) OVER (PARTITION BY prefix ORDER BY token ROWS UNBOUNDED PRECEDING) / sum(cnt) OVER (PARTITION BY prefix) AS cumulative, 2::BIGINT AS \"order\" FROM m")
def export_roundtrip(spark, sf_dir):
    from tracelet.sources.store import export_model

    where = folder(spark)
    export_model(model.train(inputs.sequences(spark, sf_dir), 2), where)
    rows = spark.read.json(where)
    return rows.select("prefix", "order", F.inline("tokens"))


LOGGED = unseen_sql(DETECT, 0.05)


@query(f"SELECT 'site' AS model_key, type, sequence, round(score, 6) AS score, count, severity, day FROM ({LOGGED}), (SELECT unnest([DATE '2024-02-03', DATE '2024-02-10']) AS day) ")
def anomaly_log(spark, sf_dir):
    """Findings of three runs in the log, of which a report over ten days reads two."""
    where, found = folder(spark), detect.unseen(context(spark, sf_dir))
    for day in (datetime(2024, 1, 20), datetime(2024, 2, 3), datetime(2024, 2, 10)):
        sinks.append_anomalies(found, where, "site", day)
    sinks.append_anomalies(found, where, "another", datetime(2024, 2, 10))
    read = report.recent_anomalies(sinks.read_log(spark, where), "site", datetime(2024, 2, 12), "10d", limit=None)
    return read.select("model_key", "type", "sequence", F.round("score", 6).alias("score"), "count", F.get_json_object("metadata", "$.severity").alias("severity"), F.to_date("detected_at").alias("day"))


@query(RANKED + " SELECT 'site' AS model_key, 'weekly' AS tag, node, position, raw_score FROM x WHERE position < 5")
def rank_snapshot(spark, sf_dir):
    where = folder(spark)
    result = rank.analyze(rank.model_edges(model.train(inputs.sequences(spark, sf_dir), 1)), threshold=1e-12, max_iterations=12, top=5)
    sinks.rank_snapshot(result, "site", "weekly", datetime(2024, 2, 1)).write.parquet(where)
    kept = F.from_json("payload", "node string, position bigint, raw_score double")
    return spark.read.parquet(where).select("model_key", "tag", kept.alias("p")).select("model_key", "tag", "p.*")


@query(TOPS + " SELECT prefix AS seed, prefix, rank, token, probability FROM r WHERE rank <= 3 AND NOT starts_with(prefix, '__START__')")
def prediction_export(spark, sf_dir):
    where = folder(spark)
    m = model.train(inputs.sequences(spark, sf_dir), 2)
    sinks.export_predictions(predict.predict(m, seeds(spark, sf_dir, m), limit=3), where)
    return spark.read.schema("seed string, prefix string, rank int, token string, probability double").csv(where, sep=";", header=True)


# ---------------------------------------------------------------- filters
@query(CHURN + " SELECT customer_id, score, risk_level FROM lv WHERE tickets > 0")
def churn_with_features(spark, sf_dir):
    """Records that lack a feature asked for are left out."""
    rows = inputs.customers(spark, sf_dir).withColumn("seats", F.when(F.col("support_tickets") > 0, 1))
    return churn.churn(rows, features=("seats", "customer_id")).select("customer_id", "score", "risk_level")


@query(USERS + """, f AS (SELECT min(customer_id) AS customer_id FROM us), l AS (SELECT customer_id, state, token, p, row_number() OVER (ORDER BY k) AS rank FROM us JOIN f USING (customer_id) JOIN q ON state = prefix)
SELECT customer_id, CAST(rank AS INTEGER) AS rank, state, token AS recommended_action, round(p, 6) AS probability FROM l WHERE rank <= 3""")
def nba_one_customer(spark, sf_dir):
    rows = inputs.users(spark, sf_dir)
    one = nba.for_customer(rows, rows.agg(F.min("customer_id")).first()[0])
    made = nba.next_best_actions(model.train(inputs.sequences(spark, sf_dir), 1), one, top=3)
    # probabilities of a state sum to one over eight predictions, as many as are looked up for three actions
    return six(made.select("customer_id", "rank", "state", "recommended_action", "probability"), "probability")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '2001-08-01'")
def entries_that_are_valid(spark, sf_dir):
    """Stored entries with an expiry (orders, 90 days) or without one (those that are pending)."""
    o = inputs.table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("expires_at"))
    return valid(rows, inputs.NOW).select("o_orderkey")


# ---------------------------------------------------------------- the fluent face
@query(TOPS + " SELECT prefix AS seed, prefix, rank, token AS path, probability, probability * 100 AS confidence, '2024-01-01' AS filter_from, '2024-01-31' AS filter_to, 'january' AS filter_label FROM r WHERE rank <= 2 AND NOT starts_with(prefix, '__START__')")
def chain_analyze(spark, sf_dir):
    """The analyzer that a chain's subject names, with the options that the chain has collected."""
    chain = Manager(spark, EngineConfig(order=2)).chain().train(inputs.sequences(spark, sf_dir)).from_date_range("2024-01-01", "2024-01-31").for_label("january")
    return chain.analyze("navigation", seed=seeds(spark, sf_dir, chain.model()), limit=2)


SAVED = "SELECT {key} AS key, string_split(regexp_replace(trim(t), '\\s+', ' ', 'g'), ' ') AS toks FROM (SELECT c_custkey AS key, unnest([c_name, c_mktsegment]) AS t FROM customer WHERE c_acctbal > 0) WHERE trim(t) <> ''".replace("{key}", "key")


@query(f"WITH sv AS ({SAVED}), {sql_model(1, 'sv')} SELECT prefix, token, cnt, probability FROM m")
def stream_saved_rows(spark, sf_dir):
    """The model that training on save has made of two columns of the customers with a positive balance."""
    root = folder(spark)
    schema = inputs.table(spark, sf_dir, "customer").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/custome[r].parquet")
    live.train_on_save(arriving, root, ["c_name", "c_mktsegment"], 1, F.col("c_acctbal") > 0).awaitTermination()
    return live.trained(spark, root, 1).transitions


@query(f"WITH {SEQS}, {sql_model(2)} SELECT prefix, token, cnt, probability FROM m")
def snapshot_roundtrip(spark, sf_dir):
    """Kept compressed and encrypted under a tag, read back after the model itself was forgotten."""
    from tracelet.sources.store import ParquetStore

    store, secret = ParquetStore(spark, folder(spark)), "0123456789abcdef"
    store.put("site", model.train(inputs.sequences(spark, sf_dir), 2))
    store.snapshot("site", "kept", codec="gzip", password=secret)
    store.forget("site")
    return store.get("site", tag="kept", password=secret).transitions


def start(order: int) -> str:
    return " ".join(["__START__"] * order)


@query(f"""WITH RECURSIVE {SEQS}, {sql_model(1)},
c AS (SELECT prefix, token, sum(cnt) OVER (PARTITION BY prefix ORDER BY token ROWS UNBOUNDED PRECEDING) / sum(cnt) OVER (PARTITION BY prefix) AS upper FROM m),
w AS (SELECT id AS walk, 0 AS step, '{start(1)}' AS prefix, CAST([] AS VARCHAR[]) AS tokens FROM range(20) AS r(id)
 UNION ALL
 SELECT walk, step + 1, CASE WHEN t <> '__END__' THEN t END, CASE WHEN t <> '__END__' THEN list_append(tokens, t) ELSE tokens END
 FROM (SELECT walk, step, w.prefix, tokens, (SELECT arg_min(token, upper) FROM c WHERE c.prefix = w.prefix AND upper > CAST(('0x' || substr(md5('5:' || walk || ':' || step), 1, 8)) AS UBIGINT) / 4294967296.0) AS t FROM w WHERE step < 5 AND w.prefix IS NOT NULL))
SELECT walk, '[' || array_to_string(list_transform(tokens, lambda t: '"' || t || '"'), ',') || ']' AS text FROM (SELECT *, row_number() OVER (PARTITION BY walk ORDER BY step DESC) AS r FROM w) WHERE r = 1""")
def generated_sequences(spark, sf_dir):
    chain = Manager(spark, EngineConfig(order=1)).chain().train(inputs.sequences(spark, sf_dir))
    return chain.generate_sequence(5, as_array=True, walks=20, random_seed=5)


@query(CHURN.replace("WITH ", "WITH lt AS (" + LTV + SPARSE + " SELECT customer_id, g.segment, round(ltv_score, 2) AS ltv_score, round(churn, 2) AS typical_churn_rate FROM g JOIN ss USING (segment)), ", 1) + " SELECT customer_id, score, risk_level, segment, ltv_score, typical_churn_rate FROM lv LEFT JOIN lt USING (customer_id)")
def predictive_from_model(spark, sf_dir):
    """Churn and lifetime value of the records that are stored with a model of the session, without a dataset."""
    manager = Manager(spark, EngineConfig(order=1))
    rows = sparse(inputs.customers(spark, sf_dir))
    manager.chain().train(inputs.sequences(spark, sf_dir)).with_records(rows).save("customers")
    ask: Predictive = manager.predictive("customers")
    value = ask.ltv(first_days=FIRST_DAYS).select("customer_id", "segment", "ltv_score", F.col("segment_characteristics.typical_churn_rate").alias("typical_churn_rate"))
    return ask.churn_score().select("customer_id", "score", "risk_level").join(value, "customer_id", "left")


@query(METRICS + """, f2 AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM f) SELECT states, transitions, sequence_count, unique_sequences FROM t, q""")
def report_summary(spark, sf_dir):
    """The summary of a report in its JSON form."""
    made = report.build(model.train(inputs.sequences(spark, sf_dir), 2), "site", datetime(2024, 2, 1), sections=("summary",))
    summary = json.loads(report.render(made, "json"))["summary"]
    return spark.createDataFrame([tuple(summary[k] for k in ("states", "transitions", "sequence_count", "unique_sequences"))], "states long, transitions long, sequence_count long, unique_sequences long")


# ---------------------------------------------------------------- insights and schedules
INSIGHTS = f"""WITH a AS (WITH {REVENUE.format(w=9)}, {groups_sql(DAY)} SELECT 'day_of_week' AS pattern_type, label, round(average, 4) AS average, round(average / overall, 2) AS multiplier, strength FROM gr, ov, st),
b AS (SELECT pattern_type, arg_max(label, {{'a': average, 'l': label}}) AS top, arg_max(multiplier, {{'a': average, 'l': label}}) AS m, arg_min(label, {{'a': average, 'l': label}}) AS low FROM a WHERE strength > 0.15 GROUP BY 1)
SELECT pattern_type, 'Campaigns pay most on ' || top AS insight, CAST(CAST(round((m - 1) * 100) AS INTEGER) AS VARCHAR) || '%' AS expected_lift FROM b UNION ALL SELECT pattern_type, low || ' is the weakest day', NULL FROM b"""


@query(INSIGHTS)
def seasonal_insights(spark, sf_dir):
    return forecast.insights(forecast.details(inputs.daily_revenue(spark, sf_dir, 9), ("day_of_week",)))


@query(f"WITH {HOURLY}, {groups_sql(HOUR)}, g AS (SELECT label, round(average, 4) AS average FROM gr) SELECT 'hour_of_day' AS pattern_type, 'Use peaks around ' || arg_max(label, {{'a': average, 'l': label}}) AS insight, CAST(NULL AS VARCHAR) AS expected_lift FROM g, st WHERE strength > 0.0001")
def hourly_insights(spark, sf_dir):
    return forecast.insights(forecast.details(inputs.hourly_events(spark, sf_dir), ("hour_of_day",), gate=0.0001))


@query("""WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:07:00', TIMESTAMP '2024-03-31 00:07:00', INTERVAL 7 HOUR)) AS t)
SELECT t AS as_of, date_trunc('hour', t) + INTERVAL 75 MINUTE AS hourly,
 date_trunc('day', t) + INTERVAL '9 hours 30 minutes' + CASE WHEN date_trunc('day', t) + INTERVAL '9 hours 30 minutes' > t THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS daily,
 date_trunc('week', t) + INTERVAL 8 HOUR + CASE WHEN date_trunc('week', t) + INTERVAL 8 HOUR > t THEN INTERVAL 0 DAY ELSE INTERVAL 7 DAY END AS weekly,
 CASE WHEN last_day(t) + INTERVAL 6 HOUR > t THEN last_day(t) + INTERVAL 6 HOUR ELSE last_day(CAST(date_trunc('month', t) + INTERVAL 1 MONTH AS DATE)) + INTERVAL 6 HOUR END AS monthly FROM s""")
def schedule_next_runs(spark, sf_dir):
    """When schedules run next, asked every seven hours of a quarter."""
    from datetime import timedelta

    asked = [datetime(2024, 1, 1, 0, 7) + timedelta(hours=7 * i) for i in range(313) if datetime(2024, 1, 1, 0, 7) + timedelta(hours=7 * i) <= datetime(2024, 3, 31, 0, 7)]
    rows = [(t, next_run(t, "hourly", "15"), next_run(t, "daily", "09:30"), next_run(t, "weekly", "mon 08:00"), next_run(t, "monthly", "31 06:00")) for t in asked]
    return spark.createDataFrame([tuple(x.isoformat(" ") for x in r) for r in rows], "as_of string, hourly string, daily string, weekly string, monthly string").select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("as_of", "hourly", "daily", "weekly", "monthly")])


# ---------------------------------------------------------------- streams
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")  # a pattern, as the source takes folders or patterns


@query("""WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w + INTERVAL 6 HOURS > ts THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x),
z AS (SELECT user_id, session, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS stop, array_to_string(list(event_type ORDER BY ts, event_id), ' ') AS sequence FROM y GROUP BY 1, 2)
SELECT user_id, CAST(start AS TIMESTAMP) AS start, CAST(stop AS TIMESTAMP) AS stop, sequence FROM z WHERE stop <= (SELECT max(ts) FROM events)""")
def stream_sessions(spark, sf_dir):
    """The sessions that a stream over the same events has closed when it has read what there is."""
    where = folder(spark)
    closed = live.session_stream(streamed(spark, sf_dir), gap="6 hours", watermark="0 seconds")
    closed.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"), F.array_join("tokens", " ").alias("sequence"))


@query(f"WITH {SEQS}, {BASE}, {CUR}, {sql_model(2, 'base')}, {sql_freq('cur', 'cf')}, u AS ({unseen_sql(DETECT, 0.05)}) SELECT sequence, round(score, 6) AS score, severity, CASE severity WHEN 'critical' THEN 'pager' WHEN 'high' THEN 'mail' ELSE 'log' END AS channel FROM u")
def stream_monitor(spark, sf_dir):
    """What monitoring a stream of the current sequences finds against the baseline, and where it goes."""
    where = folder(spark)
    now = inputs.current(spark, sf_dir).select("tokens")
    now.coalesce(1).write.parquet(f"{where}/in")  # one file, so one batch sees all of them
    arriving = spark.readStream.schema(now.schema).parquet(f"{where}/in")

    def sink(found: DataFrame, alerts: DataFrame, batch: int) -> None:
        found.where("detector = 'unseen'").select("sequence", F.round("score", 6).alias("score"), "severity").join(F.broadcast(alerts.select("severity", "channel").distinct()), "severity").write.mode("overwrite").parquet(f"{where}/found/batch={batch}")

    base = replace(context(spark, sf_dir)).baseline
    channels = {"critical": "pager", "high": "mail", "medium": "log", "low": "log", "info": "log"}
    live.monitor_stream(arriving, base, f"{where}/progress", sink, detect.Config(threshold=0.05), channels).awaitTermination()
    return spark.read.parquet(f"{where}/found").select("sequence", "score", "severity", "channel")
