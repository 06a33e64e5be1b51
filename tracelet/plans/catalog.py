"""The registered queries of the library's own operators, and SQL for each.

Doubles that depend on the order of a sum are rounded to six places in both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelet.functions import stats
from tracelet.functions.records import leaves
from tracelet.functions.staging import shared_dir
from tracelet.functions.text import group_key, tokenize
from tracelet.operators import churn, cluster, detect, forecast, generate, ltv, model, nba, predict, rank, report
from tracelet.plans import inputs
from tracelet.sources.readers import sessions
from tracelet.sources.store import ParquetStore
from tracelet.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- SQL building blocks
SEQS = "seqs AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(event_type ORDER BY ts, event_id) AS toks FROM events GROUP BY 1, 2)"
BASE, CUR = f"base AS (SELECT * FROM seqs WHERE day < '{inputs.SPLIT}')", f"cur AS (SELECT * FROM seqs WHERE day >= '{inputs.SPLIT}')"


def start(order: int) -> str:
    return " ".join(["__START__"] * order)


def sql_model(order: int, src: str = "seqs", name: str = "m", toks: str = "toks") -> str:
    pad = ", ".join(["'__START__'"] * order)
    return f"""{name}_p AS (SELECT list_concat(list_concat([{pad}], {toks}), ['__END__']) AS s FROM {src} WHERE len({toks}) > 0),
{name}_e AS (SELECT array_to_string(s[i - {order}:i - 1], ' ') AS prefix, s[i] AS token FROM {name}_p, unnest(range({order + 1}, len(s) + 1)) AS u(i)),
{name}_c AS (SELECT prefix, token, count(*) AS cnt FROM {name}_e GROUP BY 1, 2),
{name} AS (SELECT prefix, token, cnt, cnt / sum(cnt) OVER (PARTITION BY prefix) AS probability FROM {name}_c)"""


def sql_freq(src: str, name: str) -> str:
    return f"{name} AS (SELECT array_to_string(toks, ' ') AS sequence, count(*) AS n FROM {src} GROUP BY 1)"


def sql_probability(order: int, freq: str = "cf", m: str = "m", name: str = "sp") -> str:
    pad = ", ".join(["'__START__'"] * order)
    return f"""{name}_s AS (SELECT sequence, list_concat(list_concat([{pad}], string_split(sequence, ' ')), ['__END__']) AS s FROM {freq}),
{name}_t AS (SELECT sequence, i, array_to_string(s[i - {order}:i - 1], ' ') AS prefix, s[i] AS token FROM {name}_s, unnest(range({order + 1}, len(s) + 1)) AS u(i)),
{name} AS (SELECT sequence, list_reduce(list(coalesce(probability, 0.0) ORDER BY i), lambda a, b: a * b) AS probability FROM {name}_t LEFT JOIN {m} USING (prefix, token) GROUP BY 1)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---------------------------------------------------------------- models
def transitions_sql(order: int) -> str:
    return f"WITH {SEQS}, {sql_model(order)} SELECT prefix, token, cnt, probability FROM m"


@query(transitions_sql(1))
def transitions_k1(spark, sf_dir):
    return model.train(inputs.sequences(spark, sf_dir), 1).transitions


@query(transitions_sql(2))
def transitions_k2(spark, sf_dir):
    return model.train(inputs.sequences(spark, sf_dir), 2).transitions


@query(transitions_sql(3))
def transitions_k3(spark, sf_dir):
    return model.train(inputs.sequences(spark, sf_dir), 3).transitions


@query(f"WITH {SEQS}, {sql_freq('seqs', 'f')} SELECT sequence, n FROM f")
def sequence_freq(spark, sf_dir):
    return model.sequence_freq(inputs.sequences(spark, sf_dir))


@query(f"WITH {SEQS}, {sql_model(2)} SELECT *, sum(cnt) OVER (PARTITION BY prefix ORDER BY token ROWS UNBOUNDED PRECEDING) / sum(cnt) OVER (PARTITION BY prefix) AS cumulative FROM m")
def cumulative_model(spark, sf_dir):
    return model.cumulative(model.train(inputs.sequences(spark, sf_dir), 2).transitions)


@query(f"WITH {SEQS}, {sql_model(2)} SELECT prefix, token, string_split(prefix, ' ')[2] || ' ' || token AS next_prefix FROM m WHERE token <> '__END__'")
def transition_map(spark, sf_dir):
    return model.transition_map(model.train(inputs.sequences(spark, sf_dir), 2).transitions, 2)


METRICS = f"""WITH {SEQS}, {sql_model(2)}, {sql_freq('seqs', 'f')},
t AS (SELECT count(DISTINCT prefix) AS states, count(*) AS transitions, round(avg(probability), 6) AS avg_probability, round(max(probability), 6) AS max_probability FROM m),
q AS (SELECT CAST(sum(n) AS BIGINT) AS sequence_count, count(*) AS unique_sequences, round(max(n) / sum(n), 4) AS confidence FROM f)"""


@query(METRICS + " SELECT * FROM t, q")
def model_metrics(spark, sf_dir):
    return six(model.metrics(model.train(inputs.sequences(spark, sf_dir), 2)), "avg_probability", "max_probability")


@query(transitions_sql(2))
def incremental_merge(spark, sf_dir):
    return model.merge(model.train(inputs.baseline(spark, sf_dir), 2), model.train(inputs.current(spark, sf_dir), 2)).transitions


@query(transitions_sql(2))
def train_from_frequencies(spark, sf_dir):
    return model.train_from_frequencies(model.sequence_freq(inputs.sequences(spark, sf_dir)), 2).transitions


@query(transitions_sql(2))
def store_roundtrip(spark, sf_dir):
    """Stored, read back and read from there."""
    import uuid

    store = ParquetStore(spark, f"{shared_dir(spark)}/models-{uuid.uuid4().hex}")
    store.put("events", model.train(inputs.sequences(spark, sf_dir), 2))
    return store.get("events").transitions


@query(r"""WITH d AS (SELECT list_filter(string_split(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), lambda t: t <> '') AS toks FROM documents), """ + sql_model(1, "d") + " SELECT cnt, count(*) AS pairs, count(DISTINCT prefix) AS prefixes FROM m GROUP BY cnt")
def document_transitions(spark, sf_dir):
    """How many pairs of words stand in documents how often."""
    rows = model.token_rows(inputs.table(spark, sf_dir, "documents").select("text"))
    return model.train(rows, 1).transitions.groupBy("cnt").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("prefix").alias("prefixes"))


@query(r"""SELECT lang, count(*) AS docs, CAST(sum(len(list_filter(string_split(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), lambda t: t <> ''))) AS BIGINT) AS tokens FROM documents GROUP BY lang""")
def token_counts(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(tokenize(F.col("text")))).alias("tokens"))


# ---------------------------------------------------------------- prediction and walks
TOPS = f"""WITH {SEQS}, {sql_model(2)},
r AS (SELECT prefix, token, probability, CAST(row_number() OVER (PARTITION BY prefix ORDER BY probability DESC, token) AS INTEGER) AS rank FROM m WHERE token <> '__END__')"""


def seeds(spark, sf_dir, m: model.Model) -> DataFrame:
    return m.transitions.where(~F.startswith("prefix", F.lit("__START__"))).select(F.col("prefix").alias("seed")).distinct()


@query(TOPS + " SELECT prefix AS seed, prefix, rank, token, probability FROM r WHERE rank <= 3 AND NOT starts_with(prefix, '__START__')")
def predict_topk(spark, sf_dir):
    m = model.train(inputs.sequences(spark, sf_dir), 2)
    return predict.predict(m, seeds(spark, sf_dir, m), limit=3)


@query(TOPS + " SELECT prefix AS seed, prefix, rank, token AS path, probability, probability * 100 AS confidence, '2024-01-01' AS filter_from, '2024-01-31' AS filter_to, 'january' AS filter_label FROM r WHERE rank <= 5 AND NOT starts_with(prefix, '__START__')")
def predict_navigation(spark, sf_dir):
    m = model.train(inputs.sequences(spark, sf_dir), 2)
    return predict.navigation(predict.predict(m, seeds(spark, sf_dir, m), limit=5), **{"from": "2024-01-01", "to": "2024-01-31", "label": "january"})


@query(TOPS + f", s AS (SELECT unnest(['no such step', '', NULL]) AS seed) SELECT seed, '{start(2)}' AS prefix, rank, token, probability FROM s, r WHERE rank <= 3 AND prefix = '{start(2)}'")
def predict_unknown_seed(spark, sf_dir):
    m = model.train(inputs.sequences(spark, sf_dir), 2)
    return predict.predict(m, spark.createDataFrame([("no such step",), ("",), (None,)], "seed string"), limit=3)


DETECT = f"WITH {SEQS}, {BASE}, {CUR}, {sql_model(2, 'base')}, {sql_freq('cur', 'cf')}, {sql_freq('base', 'bf')}, {sql_probability(2)}"


def context(spark, sf_dir, order: int = 2) -> detect.Context:
    return detect.Context(model.train(inputs.baseline(spark, sf_dir), order), model.sequence_freq(inputs.current(spark, sf_dir)))


@query(DETECT + " SELECT sequence, probability FROM sp")
def sequence_probability(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return predict.sequence_probability(ctx.baseline, ctx.current)


DETECT3 = f"WITH {SEQS}, {BASE}, {CUR}, {sql_model(3, 'base')}, {sql_freq('cur', 'cf')}, {sql_probability(3)}"


@query(DETECT3 + " SELECT sequence, probability FROM sp")
def sequence_probability_k3(spark, sf_dir):
    ctx = context(spark, sf_dir, 3)
    return predict.sequence_probability(ctx.baseline, ctx.current)


WALK = f"""WITH RECURSIVE {SEQS}, {sql_model(2)},
c AS (SELECT prefix, token, sum(cnt) OVER (PARTITION BY prefix ORDER BY token ROWS UNBOUNDED PRECEDING) / sum(cnt) OVER (PARTITION BY prefix) AS upper FROM m),
w AS (SELECT id AS walk, 0 AS step, '{start(2)}' AS prefix, CAST([] AS VARCHAR[]) AS tokens FROM range(100) AS r(id)
 UNION ALL
 SELECT walk, step + 1, CASE WHEN t <> '__END__' THEN string_split(prefix, ' ')[2] || ' ' || t END, CASE WHEN t <> '__END__' THEN list_append(tokens, t) ELSE tokens END
 FROM (SELECT walk, step, w.prefix, tokens, (SELECT arg_min(token, upper) FROM c WHERE c.prefix = w.prefix AND upper > CAST(('0x' || substr(md5('7:' || walk || ':' || step), 1, 8)) AS UBIGINT) / 4294967296.0) AS t FROM w WHERE step < 10 AND w.prefix IS NOT NULL))"""


@query(WALK + " SELECT walk, tokens FROM (SELECT *, row_number() OVER (PARTITION BY walk ORDER BY step DESC) AS r FROM w) WHERE r = 1".replace("SELECT walk, tokens", "SELECT walk, array_to_string(tokens, ' ') AS text"))
def walk_md5(spark, sf_dir):
    m = model.train(inputs.sequences(spark, sf_dir), 2)
    return generate.as_text(generate.walks(m, spark.range(100).withColumnRenamed("id", "walk"), 10, seed=7))


# ---------------------------------------------------------------- detection
UNSEEN_SEVERITY = "CASE WHEN probability <= 0 THEN 'critical' WHEN probability < 0.01 THEN 'high' WHEN probability < 0.05 THEN 'medium' ELSE 'low' END"


def unseen_sql(head: str, threshold: float) -> str:
    return head + f" SELECT sequence, 'unseen_sequence' AS type, probability, 1 - probability AS score, {UNSEEN_SEVERITY} AS severity, n AS count FROM cf JOIN sp USING (sequence) WHERE len(string_split(sequence, ' ')) >= 2 AND probability < {threshold}"


@query(unseen_sql(DETECT, 0.05))
def unseen_sequences(spark, sf_dir):
    return detect.unseen(context(spark, sf_dir))


@query(unseen_sql(DETECT3, 0.0005))
def unseen_sequences_k3(spark, sf_dir):
    return detect.unseen(context(spark, sf_dir, 3), detect.Config(threshold=0.0005))


GROWTH = DETECT + ", g AS (SELECT cf.sequence, cf.n, coalesce(bf.n, 0) AS b, CASE WHEN coalesce(bf.n, 0) = 0 THEN 1.0 ELSE (cf.n - bf.n) / greatest(1, bf.n) END AS growth FROM cf LEFT JOIN bf USING (sequence))"


@query(GROWTH + """, h AS (SELECT sequence, list(v ORDER BY day) AS vs, min(day) AS d0 FROM (SELECT array_to_string(toks, ' ') AS sequence, day, count(*) AS v FROM seqs GROUP BY 1, 2) GROUP BY 1)
SELECT sequence, 'emerging_pattern' AS type, n AS count, b AS baseline_count, growth,
 CASE WHEN growth >= 0 THEN '+' ELSE '' END || CAST(CAST(round(growth * 100) AS BIGINT) AS VARCHAR) || '%' AS growth_label,
 greatest(0.5, least(1.0, round(1 - exp(-abs(growth)), 4))) AS confidence,
 CASE WHEN len(vs) < 3 THEN 'stable' WHEN vs[-3] < vs[-2] AND vs[-2] < vs[-1] THEN 'accelerating' WHEN vs[-3] > vs[-2] AND vs[-2] > vs[-1] THEN 'decelerating' ELSE 'stable' END AS trend,
 d0 AS first_seen, CAST(len(vs) AS INTEGER) AS days_active
FROM g JOIN h USING (sequence) WHERE n >= 3 AND NOT (b > 0 AND growth < -0.5)""")
def emerging_patterns(spark, sf_dir):
    from pyspark.sql import Window

    ctx = context(spark, sf_dir)
    days = inputs.sequences(spark, sf_dir).groupBy(F.array_join("tokens", " ").alias("sequence"), F.col("session").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    history = days.withColumn("pos", F.row_number().over(Window.partitionBy("sequence").orderBy("label")))
    return detect.emerging(replace(ctx, history=history), detect.Config(min_frequency=3, growth=-0.5))


PROFILE = f"""WITH e AS (SELECT ts < TIMESTAMP '{inputs.SPLIT}' AS old, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS wd, strftime(ts, '%H') AS hr FROM events),
x AS (SELECT 'weekday' AS metric, wd AS bucket, old FROM e UNION ALL SELECT 'hour', hr, old FROM e),
y AS (SELECT metric, bucket, count(*) FILTER (old) AS b, count(*) FILTER (NOT old) AS c FROM x GROUP BY 1, 2),
p AS (SELECT metric, bucket, greatest(b / sum(b) OVER (PARTITION BY metric), 1e-9) AS p, greatest(c / sum(c) OVER (PARTITION BY metric), 1e-9) AS q FROM y),
k AS (SELECT metric, greatest(sum(p * ln(p / q)), 0.0) AS d FROM p GROUP BY 1)
SELECT 'seasonality' AS type, metric || '_effect' AS pattern, round(d, 6) AS divergence, round(least(1.0, d), 6) AS significance,
 CASE WHEN d >= 1.2 THEN 'critical' WHEN d >= 0.8 THEN 'high' WHEN d >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM k"""


def season(spark, sf_dir, metric: str) -> DataFrame:
    ctx = replace(context(spark, sf_dir), seasonality=inputs.seasonality_profile(spark, sf_dir))
    return six(detect.seasonality(ctx, detect.Config(seasonality_threshold=0.0, metrics=(metric,))), "divergence", "significance")


@query(PROFILE + " WHERE metric = 'weekday'")
def seasonality_weekday(spark, sf_dir):
    return season(spark, sf_dir, "weekday")


@query(PROFILE + " WHERE metric = 'hour'")
def seasonality_hour(spark, sf_dir):
    return season(spark, sf_dir, "hour")


DRIFT = """, dr AS (SELECT (SELECT sum(len(string_split(sequence, ' ')) * n) / sum(n) FROM bf) AS bm, (SELECT sum(len(string_split(sequence, ' ')) * n) / sum(n) FROM cf) AS cm)"""
DRIFT_SEVERITY = "CASE WHEN abs((cm - bm) / bm) >= 0.5 THEN 'critical' WHEN abs((cm - bm) / bm) >= 0.3 THEN 'high' WHEN abs((cm - bm) / bm) >= 0.15 THEN 'medium' ELSE 'low' END"


@query(DETECT + DRIFT + f" SELECT 'drift' AS type, bm AS baseline_mean, cm AS current_mean, (cm - bm) / bm AS relative, CASE WHEN cm >= bm THEN 'upward' ELSE 'downward' END AS direction, {DRIFT_SEVERITY} AS severity FROM dr")
def length_drift(spark, sf_dir):
    return detect.drift(context(spark, sf_dir), detect.Config(drift_threshold=0.0)).drop("description")


UNION = GROWTH + DRIFT + f"""
SELECT 'unseen' AS detector, sequence, round(1 - probability, 6) AS score, {UNSEEN_SEVERITY} AS severity FROM cf JOIN sp USING (sequence) WHERE len(string_split(sequence, ' ')) >= 2 AND probability < 0.005
UNION ALL SELECT 'emerging', sequence, NULL, NULL FROM g WHERE n >= 5 AND NOT (b > 0 AND growth < 0.5)
UNION ALL SELECT 'drift', NULL, NULL, {DRIFT_SEVERITY} FROM dr"""


def detector(spark, sf_dir) -> detect.AnomalyDetector:
    return detect.AnomalyDetector(context(spark, sf_dir)).unseen_sequences().emerging_patterns().drift().threshold(0.005).minimum_frequency(5).drift_threshold(0.0)


@query(UNION)
def anomalies_union(spark, sf_dir):
    return detector(spark, sf_dir).order_by("score").get().select("detector", "sequence", F.round("score", 6).alias("score"), "severity")


@query(f"SELECT severity, CASE severity WHEN 'critical' THEN 'pager' WHEN 'high' THEN 'mail' WHEN 'low' THEN 'chat' ELSE 'log' END AS channel, count(*) AS anomalies FROM (SELECT coalesce(severity, 'info') AS severity FROM ({UNION})) WHERE severity IN ('critical', 'high', 'low', 'info') GROUP BY 1, 2")
def monitor_alerts(spark, sf_dir):
    watch = detect.Monitor(detector(spark, sf_dir)).alerts({"critical": "pager", "high": "mail", "low": "chat", "info": "log"})
    return watch.check_interval("5 minutes").start()["alerts"]


# ---------------------------------------------------------------- clusters
def clusters_sql(src: str, name: str, how: str) -> str:
    return f"{name} AS (SELECT sequence, n, {how} AS cluster_id FROM {src})"


ROBIN, BAND = "CAST((row_number() OVER (ORDER BY sequence) - 1) % 3 + 1 AS INTEGER)", "CASE WHEN n >= 10 THEN 1 WHEN n <= 3 THEN 3 ELSE 2 END"


def profiles_sql(src: str, name: str, whole: str) -> str:
    """Rounded by whole numbers, half up."""
    return f"""{name}_a AS (SELECT cluster_id, count(*) AS size, sum(len(string_split(sequence, ' '))) AS l, arg_min(sequence, {{'a': -n, 'b': sequence}}) AS favorite_path, sum(n) AS f FROM {src} GROUP BY 1),
{name}_b AS (SELECT *, CAST(((l * 200 + size) // (2 * size)) AS DOUBLE) / 100 AS avg_length, least(1.0, CAST(((f * 20 + size) // (2 * size)) AS DOUBLE) / 100) AS conversion_rate FROM {name}_a),
{name} AS (SELECT cluster_id, CASE WHEN conversion_rate >= 0.6 THEN 'power_users' WHEN avg_length < 3 THEN 'quick_browsers' WHEN f >= 20 THEN 'loyal' ELSE 'general' END AS profile,
 CASE profile WHEN 'power_users' THEN 'Many sessions that end where they should' WHEN 'quick_browsers' THEN 'Sessions of one or two steps' WHEN 'loyal' THEN 'The same paths, taken often' ELSE 'Nothing stands out' END AS description, size,
 format('{{:.1f}}', CAST(((size * 2000 + w) // (2 * w)) AS DOUBLE) / 10) || '%' AS percentage, avg_length, favorite_path, conversion_rate, CAST(f AS BIGINT) AS frequency FROM {name}_b, (SELECT count(*) AS w FROM {whole}))"""


@query(f"WITH {SEQS}, {sql_freq('seqs', 'f')}, {clusters_sql('f', 'c', ROBIN)} SELECT sequence, n, cluster_id FROM c")
def cluster_round_robin(spark, sf_dir):
    return cluster.round_robin(sequence_freq(spark, sf_dir), 3)


@query(f"WITH {SEQS}, {sql_freq('seqs', 'f')}, {clusters_sql('f', 'c', BAND)} SELECT sequence, n, cluster_id FROM c")
def cluster_bands(spark, sf_dir):
    return cluster.frequency_band(sequence_freq(spark, sf_dir))


@query(f"WITH {SEQS}, {BASE}, {CUR}, {sql_freq('cur', 'cf')}, {clusters_sql('cf', 'c', ROBIN)}, {profiles_sql('c', 'p', 'cf')} SELECT * FROM p")
def cluster_profiles(spark, sf_dir):
    return cluster.profiles(cluster.round_robin(model.sequence_freq(inputs.current(spark, sf_dir)), 3))


@query(f"""WITH {SEQS}, {BASE}, {CUR}, {sql_freq('cur', 'cf')}, {sql_freq('base', 'bf')}, {clusters_sql('cf', 'c', BAND)}, {clusters_sql('bf', 'b', BAND)}, {profiles_sql('c', 'p', 'cf')}, {profiles_sql('b', 'q', 'cf')},
x AS (SELECT row_number() OVER (ORDER BY cluster_id) AS i, profile AS b FROM p), y AS (SELECT row_number() OVER (ORDER BY cluster_id) AS i, profile AS a FROM q)
SELECT count(a) AS baseline_clusters, count(b) AS current_clusters, bool_or(a IS DISTINCT FROM b) AS shifted FROM x FULL JOIN y USING (i)""")
def cluster_shift(spark, sf_dir):
    now, old = (model.sequence_freq(f(spark, sf_dir)) for f in (inputs.current, inputs.baseline))
    return cluster.shift(cluster.profiles(cluster.frequency_band(old), now), cluster.profiles(cluster.frequency_band(now)))


# ---------------------------------------------------------------- ranks
def sql_ranks(turns: int, damping: float = 0.85) -> str:
    """Unrolled iterations over ed(src, dst, w)."""
    out = f"""sh AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM ed), nd AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed),
nn AS (SELECT count(*) AS n FROM nd), da AS (SELECT id FROM nd WHERE id NOT IN (SELECT src FROM ed)), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM nd, nn)"""
    for i in range(1, turns + 1):
        a = f"r{i - 1}"
        out += f""", l{i} AS (SELECT coalesce(sum(r), 0.0) AS lost FROM {a} WHERE id IN (SELECT id FROM da)), f{i} AS (SELECT dst AS id, sum(r * s) AS f FROM sh JOIN {a} ON src = id GROUP BY 1),
r{i} AS (SELECT id, {1 - damping} / n + {damping} * coalesce(f, 0.0) + {damping} * lost / n AS r FROM nd LEFT JOIN f{i} USING (id), nn, l{i})"""
    return out


STATE_EDGES = f"{SEQS}, {sql_model(1)}, ed AS (SELECT prefix AS src, token AS dst, probability AS w FROM m)"
RANKED = f"""WITH {STATE_EDGES}, {sql_ranks(12)}, z AS (SELECT id, round(r, 10) AS r FROM r12),
x AS (SELECT id AS node, round(r, 6) AS raw_score, round((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) * 100, 2) AS normalized_score, row_number() OVER (ORDER BY r DESC, id) - 1 AS position, count(*) OVER () AS n FROM z)"""


@query(f"WITH {STATE_EDGES}, {sql_ranks(12)} SELECT id, round(r, 6) AS rank FROM r12")
def pagerank_fixed(spark, sf_dir):
    edges = rank.model_edges(model.train(inputs.sequences(spark, sf_dir), 1))
    return six(rank.pagerank(edges, max_iterations=12, check=False)[0], "rank")


@query(f"WITH {STATE_EDGES}, {sql_ranks(30)} SELECT id, round(r, 4) AS rank FROM r30")
def pagerank_converged(spark, sf_dir):
    edges = rank.model_edges(model.train(inputs.sequences(spark, sf_dir), 1))
    return rank.pagerank(edges)[0].withColumn("rank", F.round("rank", 4))


@query(RANKED + " SELECT node, raw_score, normalized_score, round(100 - position / (n - 1) * 100, 1) AS percentile, position FROM x")
def pagerank_ranked(spark, sf_dir):
    edges = rank.model_edges(model.train(inputs.sequences(spark, sf_dir), 1))
    return rank.analyze(edges, threshold=1e-12, max_iterations=12).nodes


@query(RANKED + " SELECT substr(node, 1, 1) AS group_key, count(*) AS nodes, array_to_string(list(node ORDER BY position), ' ') AS members FROM x WHERE position < 5 GROUP BY 1")
def pagerank_groups(spark, sf_dir):
    m = model.train(inputs.sequences(spark, sf_dir), 1)
    build = rank.PageRankBuilder(m).convergence_threshold(1e-12).max_iterations(12).top_nodes(5).group_by(lambda c: F.substring(c, 1, 1))
    listed = build.calculate().groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("nodes"), F.array_sort(F.collect_list(F.struct("position", "node"))).alias("m"))  # of five nodes
    return listed.select("group_key", "nodes", F.array_join("m.node", " ").alias("members"))


@query(f"WITH ed AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), {sql_ranks(4)} SELECT id, round(r, 9) AS rank FROM r4")
def pagerank_dangling(spark, sf_dir):
    return rank.pagerank(inputs.supply_edges(spark, sf_dir), max_iterations=4, check=False)[0].withColumn("rank", F.round("rank", 9))


@query(f"WITH ed AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), {sql_ranks(12)} SELECT id, round(r, 9) AS rank FROM r12")
def pagerank_supply_converged(spark, sf_dir):
    """Runs until no rank changes by more than 1e-12; the SQL's number of iterations is beyond that."""
    ranks, _, converged = rank.pagerank(inputs.supply_edges(spark, sf_dir), threshold=1e-12)
    if not converged:
        raise ValueError("ranks did not converge")
    return ranks.withColumn("rank", F.round("rank", 9))


@query(r"""WITH u AS (SELECT url, list_filter(string_split_regex(url, '[\s>]+|/'), lambda s: s <> '') AS s FROM pages)
SELECT coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#]+)', 1), ''), s[1], 'unknown') AS domain, coalesce(s[3], s[1], 'unknown') AS segment_2, coalesce(s[1], 'unknown') AS prefix, count(*) AS pages FROM u GROUP BY 1, 2, 3""")
def group_keys(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "pages").select("url")
    keys = [group_key(F.col("url"), by).alias(name) for by, name in (("domain", "domain"), ("segment:2", "segment_2"), ("prefix", "prefix"))]
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))


# ---------------------------------------------------------------- customers
CUSTOMERS = """o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderpriority, o_orderstatus FROM orders),
a AS (SELECT o_custkey, date_diff('day', max(d), DATE '2001-08-01') AS days, date_diff('day', min(d), DATE '2001-08-01') AS signup, coalesce(sum(p) FILTER (d >= DATE '2000-08-01'), 0) AS late,
 coalesce(sum(p) FILTER (d >= DATE '1999-08-01' AND d < DATE '2000-08-01'), 0) AS early, count(DISTINCT o_orderpriority) AS pr, count(DISTINCT o_orderstatus) AS st, count(*) FILTER (o_orderpriority = '1-URGENT') AS tickets,
 CAST(arg_min(p, {'a': d, 'b': o_orderkey}) AS DOUBLE) AS first_value, CAST(sum(p) AS DOUBLE) / count(*) AS aov, count(*) AS n FROM o GROUP BY 1),
c AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, days, CASE WHEN late < early THEN 'declining' WHEN late > early THEN 'growing' ELSE 'flat' END AS trend, CAST(pr AS DOUBLE) / 5 AS adoption, CAST(tickets AS DOUBLE) AS tickets, signup,
 first_value, aov, CAST(late AS DOUBLE) / 12 AS mrr, least(1.0::DOUBLE, CAST(n AS DOUBLE) / 20) AS e, least(greatest(c_acctbal / 10000, 0.0::DOUBLE), 1.0::DOUBLE) AS r, CAST(pr + st AS DOUBLE) AS f FROM customer JOIN a ON c_custkey = o_custkey)"""
PARTS = """pt AS (SELECT *, 0.4::DOUBLE * least(CAST(days AS DOUBLE) / 60, 1.0::DOUBLE) AS c1, 0.3::DOUBLE * (CASE trend WHEN 'declining' THEN 1.0::DOUBLE WHEN 'growing' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) AS c2,
 0.2::DOUBLE * (1 - least(greatest(adoption, 0.0::DOUBLE), 1.0::DOUBLE)) AS c3, 0.1::DOUBLE * least(tickets / 5, 1.0::DOUBLE) AS c4 FROM {src}),
sc AS (SELECT *, least(greatest(c1 + c2 + c3 + c4, 0.0::DOUBLE), 1.0::DOUBLE) AS score FROM pt),
lv AS (SELECT *, CASE WHEN score >= 0.7::DOUBLE THEN 'high' WHEN score >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level FROM sc)"""
CHURN = f"WITH {CUSTOMERS}, {PARTS.replace('{src}', 'c')}"


@query(CHURN + " SELECT customer_id, score, risk_level FROM lv")
def churn_scores(spark, sf_dir):
    return churn.churn(inputs.customers(spark, sf_dir)).select("customer_id", "score", "risk_level")


@query(CHURN + """, x AS (SELECT customer_id, score, unnest([{'f': 'no_login_' || days || '_days', 'c': c1}, {'f': 'usage_trend_decline', 'c': c2}, {'f': 'feature_adoption_decline', 'c': c3}, {'f': 'support_contact_increase', 'c': c4}]) AS z FROM lv)
SELECT customer_id, z.f AS factor, z.c / score AS weight FROM x WHERE z.c > 0""")
def churn_factors(spark, sf_dir):
    return churn.churn(inputs.customers(spark, sf_dir), digits=None).select("customer_id", F.inline("factors"))


@query(CHURN + """, x AS (SELECT customer_id, 'send_engagement_email' AS action, CASE WHEN risk_level = 'high' THEN 20 ELSE 15 END AS discount, CASE WHEN risk_level = 'high' THEN least(0.6::DOUBLE, score + 0.25::DOUBLE) ELSE least(0.5::DOUBLE, score + 0.18::DOUBLE) END AS expected_recovery_rate FROM lv
 UNION ALL SELECT customer_id, 'priority_support_outreach', NULL, least(0.7::DOUBLE, score + 0.3::DOUBLE) FROM lv WHERE risk_level = 'high'
 UNION ALL SELECT customer_id, 'schedule_success_call', NULL, least(0.55::DOUBLE, score + 0.22::DOUBLE) FROM lv WHERE risk_level <> 'low' AND tickets = 0)
SELECT * FROM x""")
def churn_actions(spark, sf_dir):
    return churn.churn(inputs.customers(spark, sf_dir), recommendations=True, digits=None).select("customer_id", F.inline("actions"))


@query(f"""WITH {SEQS}, {sql_freq('seqs', 'q')},
k AS (SELECT substr(sha256(sequence), 1, 12) AS customer_id, greatest(0, 30 - n) AS days, CASE WHEN n > 1 THEN 'growing' ELSE 'declining' END AS trend, least(1.0::DOUBLE, CAST(strlen(sequence) AS DOUBLE) / 120) AS adoption, CAST(greatest(0, (n + 1) // 2) AS DOUBLE) AS tickets FROM q),
{PARTS.replace('{src}', 'k')} SELECT customer_id, score, risk_level FROM lv""")
def churn_fallback(spark, sf_dir):
    return churn.churn(churn.fallback_customers(sequence_freq(spark, sf_dir))).select("customer_id", "score", "risk_level")


LTV = f"""WITH {CUSTOMERS}, el AS (SELECT *, CAST(signup AS DOUBLE) AS d FROM c WHERE signup <= 2200),
s AS (SELECT *, greatest(120.0::DOUBLE, aov * (1 + e)) * 1.8::DOUBLE * (1 + least(f / 12, 1.5::DOUBLE)) * (1 + 0.8::DOUBLE * e) * (1 + 0.5::DOUBLE * r) AS ltv_score,
 least(greatest(0.55::DOUBLE + 0.35::DOUBLE * e + least(0.1::DOUBLE, (1 + least(f / 12, 1.5::DOUBLE)) / 20) - least(0.15::DOUBLE, d / 120), 0.0::DOUBLE), 1.0::DOUBLE) AS confidence FROM el),
t AS (SELECT quantile_cont(ltv_score, (100 - 100.0::DOUBLE / 3) / 100) AS t0, quantile_cont(ltv_score, (100 - 200.0::DOUBLE / 3) / 100) AS t1 FROM s),
g AS (SELECT s.*, CASE WHEN ltv_score >= t0 THEN 'high' WHEN ltv_score >= t1 THEN 'medium' ELSE 'at_risk' END AS segment FROM s, t)"""
FIRST_DAYS = 2200


def scored(spark, sf_dir) -> DataFrame:
    return ltv.segmented(ltv.scores(inputs.customers(spark, sf_dir), FIRST_DAYS))


@query(LTV + " SELECT customer_id, round(ltv_score, 6) AS ltv_score, round(confidence, 6) AS confidence FROM s")
def ltv_scores(spark, sf_dir):
    return six(ltv.scores(inputs.customers(spark, sf_dir), FIRST_DAYS).select("customer_id", "ltv_score", "confidence"), "ltv_score", "confidence")


@query(LTV + " SELECT customer_id, segment FROM g")
def ltv_segments(spark, sf_dir):
    return scored(spark, sf_dir).select("customer_id", "segment")


#: Some customers tell their churn, retention, revenue and chance of expansion, others don't: by the customer's number modulo 4, 5 and 3.
SPARSE = """, sp AS (SELECT *, CAST(customer_id AS BIGINT) AS i FROM g),
u AS (SELECT *, CASE segment WHEN 'high' THEN 0.08::DOUBLE WHEN 'medium' THEN 0.18::DOUBLE ELSE 0.31::DOUBLE END AS us_c,
 CASE segment WHEN 'high' THEN 89.0::DOUBLE WHEN 'medium' THEN 54.0::DOUBLE ELSE 32.0::DOUBLE END AS us_m, CASE segment WHEN 'high' THEN 0.56::DOUBLE WHEN 'medium' THEN 0.32::DOUBLE ELSE 0.18::DOUBLE END AS us_e FROM sp),
ss AS (SELECT segment, count(*) AS customers,
 avg(CASE i % 4 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 1 - 0.9::DOUBLE ELSE us_c END) AS churn, avg(CASE WHEN i % 5 = 0 THEN us_m ELSE mrr END) AS mrr,
 avg(CASE i % 3 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE us_e END) AS expansion, avg(ltv_score) AS ltv FROM u GROUP BY 1)"""


def sparse(rows: DataFrame) -> DataFrame:
    i = F.col("customer_id").cast("long")
    return rows.withColumns({
        "churn_rate": F.when(i % 4 == 0, 0.05), "retention_rate": F.when(i % 4 == 1, 0.9), "mrr": F.when(i % 5 != 0, F.col("mrr")),
        "expansion_probability": F.when(i % 3 == 0, 0.7), "upsell_likelihood": F.when(i % 3 == 1, 0.4),
    })


@query(LTV + SPARSE + " SELECT segment, customers, round(churn, 6) AS avg_churn_rate, round(mrr, 6) AS avg_mrr, round(expansion, 6) AS avg_expansion, round(ltv, 6) AS avg_ltv FROM ss")
def ltv_segment_stats(spark, sf_dir):
    return six(ltv.segment_stats(sparse(scored(spark, sf_dir))), "avg_churn_rate", "avg_mrr", "avg_expansion", "avg_ltv")


@query(LTV + SPARSE + " SELECT customer_id, g.segment, round(churn, 2) AS typical_churn_rate, round(ss.mrr, 2) AS average_mrr, round(expansion, 2) AS expansion_probability, round(ltv, 2) AS average_ltv FROM g JOIN ss USING (segment)")
def ltv_characteristics(spark, sf_dir):
    """What is attached to each prediction."""
    return ltv.ltv(sparse(inputs.customers(spark, sf_dir)), FIRST_DAYS).select("customer_id", "segment", "segment_characteristics.*")


@query(LTV + " SELECT customer_id, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE percent_rank() OVER (ORDER BY ltv_score) END AS ltv_percentile, round(ltv_score - avg(ltv_score) OVER (), 3) AS vs_average, round(ltv_score - quantile_cont(ltv_score, 0.5) OVER (), 3) AS vs_median FROM g")
def ltv_cohort(spark, sf_dir):
    made = ltv.cohort(scored(spark, sf_dir))  # differences of sums in the hundred thousands: three places
    return made.select("customer_id", "ltv_percentile", F.round("vs_average", 3).alias("vs_average"), F.round("vs_median", 3).alias("vs_median"))


@query(LTV + """ SELECT customer_id, 'upsell_premium_tier' AS action, CAST(NULL AS VARCHAR) AS current_plan, 'professional' AS recommended_plan, CAST(NULL AS VARCHAR) AS program, 1200.0::DOUBLE AS estimated_ltv_increase, 0.48::DOUBLE AS success_probability FROM g WHERE segment = 'high'
UNION ALL SELECT customer_id, 'invite_to_success_program', NULL, NULL, 'executive_briefing', 450.0::DOUBLE, 0.36::DOUBLE FROM g WHERE segment <> 'at_risk'""")
def ltv_actions(spark, sf_dir):
    return ltv.ltv(inputs.customers(spark, sf_dir), FIRST_DAYS).select("customer_id", F.inline("actions"))


USERS = f"""WITH {SEQS}, {sql_model(1)}, us AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, arg_max(event_type, {{'a': ts, 'b': event_id}}) AS state FROM events GROUP BY 1),
r AS (SELECT prefix, token, probability, row_number() OVER (PARTITION BY prefix ORDER BY probability DESC, token) AS k FROM m WHERE token <> '__END__'),
q AS (SELECT prefix, token, k, probability / sum(probability) OVER (PARTITION BY prefix) AS p FROM r WHERE k <= 8)"""


@query(USERS + """, l AS (SELECT customer_id, state, token, p, row_number() OVER (PARTITION BY customer_id ORDER BY k) AS rank FROM us JOIN q ON state = prefix WHERE token <> 'click')
SELECT customer_id, CAST(rank AS INTEGER) AS rank, state, token AS recommended_action, round(p, 6) AS probability, round(least(p * 0.6 + 0.5 * 0.2, 1.0), 6) AS engagement_lift, round(p * 0.35, 6) AS conversion_lift, round(p * 0.25 + 0.125, 6) AS retention_lift, 'in_app' AS channel, '14:30' AS optimal_time FROM l WHERE rank <= 2""")
def nba_topn(spark, sf_dir):
    m = model.train(inputs.sequences(spark, sf_dir), 1)
    rows = nba.next_best_actions(m, inputs.users(spark, sf_dir), top=2, excluded=("click",))
    return six(rows.select("customer_id", "rank", "state", "recommended_action", "probability", "engagement_lift", "conversion_lift", "retention_lift", "channel", "optimal_time"), "probability", "engagement_lift", "conversion_lift", "retention_lift")


@query(USERS + """ SELECT customer_id, i AS rank, state, ['view_feature_guide', 'invite_to_webinar', 'schedule_success_call'][i] AS recommended_action, 0.35::DOUBLE AS probability, ['in_app', 'email', 'email'][i] AS channel FROM us, unnest([1, 2, 3]) AS u(i)""")
def nba_fallback(spark, sf_dir):
    m = model.train(inputs.sequences(spark, sf_dir), 1)
    types = tuple(r[0] for r in inputs.table(spark, sf_dir, "events").select("event_type").distinct().collect())  # all: as many as the model has tokens
    return nba.next_best_actions(m, inputs.users(spark, sf_dir), top=3, excluded=types).select("customer_id", "rank", "state", "recommended_action", "probability", "channel")


# ---------------------------------------------------------------- series
REVENUE = "sr AS (SELECT d AS ts, v * CASE WHEN isodow(d) >= 6 THEN {w} ELSE 1 END AS value FROM (SELECT CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1))"
HOURLY = "sr AS (SELECT date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1)"


def groups_sql(label: str) -> str:
    return f"""gr AS (SELECT {label} AS label, count(*) AS n, avg(value) AS average, var_pop(value) AS variance FROM sr GROUP BY 1), ov AS (SELECT avg(value) AS overall FROM sr),
st AS (SELECT CASE WHEN sum(n * (average - overall) ** 2) + sum(variance * greatest(1, n - 1)) > 0 THEN sum(n * (average - overall) ** 2) / (sum(n * (average - overall) ** 2) + sum(variance * greatest(1, n - 1))) ELSE 0.0 END AS strength FROM gr, ov)"""


DAY, HOUR = "dayname(ts)", "strftime(ts, '%H') || ':00'"


@query(f"WITH {REVENUE.format(w=2)}, {groups_sql(DAY)} SELECT 'revenue_by_day' AS series, round(strength, 6) AS strength FROM st UNION ALL (WITH {HOURLY}, {groups_sql(HOUR)} SELECT 'events_by_hour', round(strength, 6) FROM st)")
def seasonal_strength(spark, sf_dir):
    a = forecast.strength(forecast.group_means(inputs.daily_revenue(spark, sf_dir, 2), "day_of_week")).select(F.lit("revenue_by_day").alias("series"), "strength")
    b = forecast.strength(forecast.group_means(inputs.hourly_events(spark, sf_dir), "hour_of_day")).select(F.lit("events_by_hour").alias("series"), "strength")
    return six(a.unionByName(b), "strength")


@query(f"WITH {REVENUE.format(w=1)}, {groups_sql(DAY)} SELECT label, n, round(average, 4) AS average, round(average / overall, 6) AS multiplier FROM gr, ov")
def day_profile(spark, sf_dir):
    g = forecast.group_means(inputs.daily_revenue(spark, sf_dir), "day_of_week")
    return g.select("label", "n", F.round("average", 4).alias("average"), F.round("multiplier", 6).alias("multiplier"))


@query(f"WITH {HOURLY}, {groups_sql(HOUR)} SELECT label, n, round(average, 4) AS average, round(average / overall, 6) AS multiplier FROM gr, ov")
def hour_profile(spark, sf_dir):
    g = forecast.group_means(inputs.hourly_events(spark, sf_dir), "hour_of_day")
    return g.select("label", "n", F.round("average", 4).alias("average"), F.round("multiplier", 6).alias("multiplier"))


@query(f"""WITH {REVENUE.format(w=9)}, {groups_sql(DAY)}, x AS (SELECT label, round(average, 4) AS average FROM gr)
SELECT 'day_of_week' AS pattern_type, round(strength, 2) AS strength, arg_max(label, average) || ' is ' || printf('%.0f', (max(average) - min(average)) * 100) || '% above ' || arg_min(label, average) AS description FROM x, st WHERE strength > 0.15 GROUP BY strength""")
def seasonal_patterns(spark, sf_dir):
    return forecast.patterns(forecast.details(inputs.daily_revenue(spark, sf_dir, 9), ("day_of_week",)))


def forecast_sql(weekend: int, horizon: int, at: str, gate: bool) -> str:
    seasonal = "coalesce((SELECT round(average, 4) FROM gr WHERE label = dayname(due)), base)" if gate else "base"
    return f"""WITH {REVENUE.format(w=weekend)}, {groups_sql(DAY)},
b AS (SELECT avg(value) AS base, (arg_max(value, ts) - arg_min(value, ts)) / date_diff('day', min(ts), max(ts)) AS slope, max(ts) AS t1 FROM sr),
i AS (SELECT CAST(i AS INTEGER) AS step, {at} AS due, base, base + slope * i AS line FROM b, unnest(range(1, {horizon + 1})) AS u(i)),
y AS (SELECT *, {seasonal} AS seasonal FROM i), z AS (SELECT *, greatest(0.0, line + (seasonal - base)) AS y FROM y)
SELECT step, CAST(due AS DATE) AS date, dayname(due) AS day_of_week, round(y, 3) AS forecasted_value, round(y - y * 0.05, 3) AS lower_bound_95, round(y + y * 0.05, 3) AS upper_bound_95, round(line, 3) AS trend_component, round(seasonal, 3) AS seasonal_component FROM z"""


def forecasted(points: DataFrame, **settings) -> DataFrame:
    made = forecast.forecast(points, **settings).drop("confidence")
    return made.withColumns({c: F.round(c, 3) for c, k in made.dtypes if k == "double"})


@query(forecast_sql(9, 30, "t1 + to_days(CAST(i AS INTEGER))", True))
def forecast_daily(spark, sf_dir):
    return forecasted(inputs.daily_revenue(spark, sf_dir, 9), components=("day_of_week",))


@query(forecast_sql(1, 6, "t1 + to_months(CAST(i AS INTEGER))", False))
def forecast_monthly(spark, sf_dir):
    return forecasted(inputs.daily_revenue(spark, sf_dir), window="monthly", horizon=6)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS deviation, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def statistics(spark, sf_dir):
    v = F.col("value")
    made = inputs.table(spark, sf_dir, "events").groupBy("event_type").agg(stats.mean(v).alias("mean"), stats.variance(v).alias("variance"), stats.deviation(v).alias("deviation"), stats.median(v).alias("median"), stats.percentile(v, 90).alias("p90"))
    return six(made, "mean", "deviation", "median", "p90").withColumn("variance", F.round("variance", 4))


# ---------------------------------------------------------------- records, reports, streams
@query("SELECT text, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS text FROM events) WHERE text IS NOT NULL AND text <> '' GROUP BY 1")
def json_leaves(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events").select(F.from_json("props", "k bigint").alias("props"))
    return leaves(e).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQS}, {sql_freq('seqs', 'f')} SELECT sequence, n AS count, round(n / sum(n) OVER (), 4) AS probability FROM f ORDER BY n DESC, sequence LIMIT 5")
def report_top_sequences(spark, sf_dir):
    return report.top_sequences(sequence_freq(spark, sf_dir))


@query(METRICS + ", x AS (SELECT unnest([CASE WHEN confidence < 0.5 THEN 'Confidence is low: train on more or more regular sequences.' END, CASE WHEN states > 1000 THEN 'There are many states: consider a lower order or merging rare tokens.' END, CASE WHEN avg_probability < 0.05 THEN 'Transitions are spread thin: consider fewer distinct tokens.' END]) AS recommendation FROM t, q) SELECT recommendation FROM x WHERE recommendation IS NOT NULL")
def report_recommendations(spark, sf_dir):
    return report.recommendations(model.metrics(model.train(inputs.sequences(spark, sf_dir), 2)))


@query("""WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w < ts - INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x)
SELECT user_id, CAST(CAST(session AS BIGINT) AS VARCHAR) AS session, array_to_string(list(event_type ORDER BY ts, event_id), ' ') AS sequence FROM y GROUP BY 1, 2""")
def sessions_by_gap(spark, sf_dir):
    rows = sessions(inputs.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), gap="6 HOURS")
    return rows.select("user_id", "session", F.array_join("tokens", " ").alias("sequence"))


@query(transitions_sql(2))
def stream_training(spark, sf_dir):
    """The model that a stream over the same events has trained when it has read what there is."""
    import uuid

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = inputs.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")  # a pattern, as the source takes folders or patterns

    def batch(rows, i):
        live.write_delta(sessions(rows), i, root, 2)

    stream.writeStream.option("checkpointLocation", f"{root}/progress").foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    return live.trained(spark, root, 2).transitions
