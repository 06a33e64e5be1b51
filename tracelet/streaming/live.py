"""Continuous training and monitoring over micro-batches.

Training appends the counts of each batch under its batch id and overwrites that id when a batch is
repeated after a failure, so every batch counts once; readers add the deltas up, and compaction
folds them. Sessions are the one stateful part: Spark's session windows behind a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelet.operators.detect import AnomalyDetector, Config, Context, route_alerts
from tracelet.operators.model import Model, counts, sequence_freq, token_rows, with_probability
from tracelet.sources.readers import corpus_from_frame

DELTA = "prefix string, token string, cnt bigint"
FREQ = "sequence string, n bigint"


def session_stream(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", key: str = "user_id", ts: str = "ts", token: str = "event_type", tie: str = "event_id") -> DataFrame:
    """(key, start, end, tokens) of closed sessions; events later than the watermark are dropped. Times without a zone are taken in the session's."""
    grouped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.array_sort(F.collect_list(F.struct(ts, tie, token))).alias("e"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.transform("e", lambda x: x[token]).alias("tokens"))


def write_delta(batch: DataFrame, batch_id: int, root: str, order: int, tokens: str = "tokens") -> None:
    counts(batch, order, tokens).write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")
    sequence_freq(batch, tokens).write.mode("overwrite").parquet(f"{root}/freq/batch={batch_id}")


def train_stream(sequences: DataFrame, root: str, order: int = 2, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Train while sequences (a column ``tokens``) arrive."""
    writer = sequences.writeStream.option("checkpointLocation", checkpoint or f"{root}/progress").foreachBatch(lambda batch, i: write_delta(batch, i, root, order))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def train_on_save(saved: DataFrame, root: str, columns: list[str], order: int = 2, when: Column | None = None, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Train on the named columns of rows as they are saved (a stream of them), each value a sequence; ``when``: which rows count."""
    chosen = saved if when is None else saved.where(when)

    def batch(rows: DataFrame, i: int) -> None:
        write_delta(token_rows(corpus_from_frame(rows, columns)), i, root, order)

    writer = chosen.writeStream.option("checkpointLocation", checkpoint or f"{root}/progress").foreachBatch(batch)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def trained(spark: SparkSession, root: str, order: int) -> Model:
    """The model that all batches so far make."""
    pairs = spark.read.schema(DELTA + ", batch string").parquet(f"{root}/counts").groupBy("prefix", "token").agg(F.sum("cnt").alias("cnt"))
    freq = spark.read.schema(FREQ + ", batch string").parquet(f"{root}/freq").groupBy("sequence").agg(F.sum("n").alias("n"))
    return Model(order, with_probability(pairs), freq)


def compact(spark: SparkSession, root: str, to: str, order: int) -> None:
    """Fold all deltas into one under a new root, while no stream writes to the old one."""
    model = trained(spark, root, order)
    model.transitions.select("prefix", "token", "cnt").write.parquet(f"{to}/counts/batch=base")
    model.sequence_freq.write.parquet(f"{to}/freq/batch=base")


def monitor_batch(baseline: Model, cfg: Config, channels: dict[str, str], sink: Callable[[DataFrame, DataFrame, int], None], detectors: tuple[str, ...] = ("unseen", "drift")) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        found = AnomalyDetector(Context(baseline, sequence_freq(batch)), cfg, detectors).get()
        sink(found, route_alerts(found, channels), batch_id)

    return run


def monitor_stream(sequences: DataFrame, baseline: Model, checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None], cfg: Config = Config(), channels: dict[str, str] | None = None, interval: str | None = None) -> StreamingQuery:
    """Run the batch detectors on every micro-batch; ``interval`` such as ``5 minutes``, or once over what is there."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return sequences.writeStream.option("checkpointLocation", checkpoint).foreachBatch(monitor_batch(baseline, cfg, channels or {}, sink)).trigger(**trigger).start()
