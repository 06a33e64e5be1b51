"""Sinks: anomaly logs, exports, notifications, and events as rows."""

from __future__ import annotations

import json
import smtplib
import urllib.request
from collections.abc import Callable, Sequence
from datetime import datetime
from email.message import EmailMessage

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.operators.rank import RankResult
from tracelet.schema import TABLES


def anomaly_rows(found: DataFrame, model_key: str, as_of: datetime) -> DataFrame:
    """Findings in the schema of the log; the score falls back to the probability, then to zero, the count to one."""
    has = lambda n: F.col(n) if n in found.columns else F.lit(None)
    rest = [c for c in found.columns if c not in ("sequence", "type", "score", "count")]
    return found.select(
        F.lit(model_key).alias("model_key"), F.col("type"), has("sequence").cast("string").alias("sequence"),
        F.coalesce(has("score").cast("double"), has("probability").cast("double"), F.lit(0.0)).alias("score"), F.coalesce(has("count").cast("long"), F.lit(1)).cast("long").alias("count"),
        F.to_json(F.struct(*rest)).alias("metadata"), F.lit(as_of).cast("timestamp").alias("detected_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def append_anomalies(found: DataFrame, path: str, model_key: str, as_of: datetime) -> None:
    anomaly_rows(found, model_key, as_of).write.mode("append").partitionBy("model_key").parquet(path)


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(TABLES["anomalies"]).parquet(path)


def export_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def export_ranks(result: RankResult, path: str, kind: str = "json") -> None:
    rows = result.nodes.orderBy("position")
    (rows.write.mode("overwrite").option("header", True).csv if kind == "csv" else rows.write.mode("overwrite").json)(path)


def rank_snapshot(result: RankResult, model_key: str, tag: str | None, as_of: datetime) -> DataFrame:
    """Ranks as rows of the snapshot table, one a node, so no payload grows with the graph."""
    return result.nodes.select(F.lit(model_key).alias("model_key"), F.lit(tag).alias("tag"), F.to_json(F.struct("*")).alias("payload"), F.lit(json.dumps(result.metadata)).alias("metadata"), F.lit(as_of).cast("timestamp").alias("created_at"))


def write_texts(texts: DataFrame, path: str) -> None:
    texts.select("text").write.mode("overwrite").text(path)


Channel = Callable[[dict], None]


def to_log(log) -> Channel:
    return lambda payload: log.info(json.dumps(payload, default=str))


def to_webhook(url: str, post: Callable[[str, bytes], None] | None = None) -> Channel:
    def send(payload: dict) -> None:
        body = json.dumps(payload, default=str).encode()
        if post is not None:
            post(url, body)
        else:
            urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=30).close()  # noqa: S310

    return send


def to_mail(sender: str, receivers: Sequence[str], subject: str, host: str = "localhost", send: Callable[[EmailMessage], None] | None = None) -> Callable[[dict | str], None]:
    """A channel that mails payloads (as JSON) or finished texts (reports; HTML where they look like it); ``send`` takes the place of an SMTP server."""

    def mail(payload: dict | str) -> None:
        text = payload if isinstance(payload, str) else json.dumps(payload, indent=2, default=str)
        message = EmailMessage()
        message["From"], message["To"], message["Subject"] = sender, ", ".join(receivers), subject
        message.set_content(text, subtype="html" if text.lstrip().startswith("<html") else "plain")
        if send is not None:
            send(message)
        else:
            with smtplib.SMTP(host) as server:
                server.send_message(message)

    return mail


def notify(payload: dict, *channels: Channel) -> int:
    for send in channels:
        send(payload)
    return len(channels)


def event_rows(name: str, rows: DataFrame, as_of: datetime) -> DataFrame:
    """Events as (event, at, payload)."""
    return rows.select(F.lit(name).alias("event"), F.lit(as_of).cast("timestamp").alias("at"), F.to_json(F.struct("*")).alias("payload"))
