"""Reports on a model: sections as small tables, renderers, delivery."""

from __future__ import annotations

import csv
import html
import io
import json
import re
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.operators.model import Model, metrics

SECTIONS = ("summary", "predictions", "anomalies", "recommendations")


def top_sequences(freq: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent sequences with their share of all."""
    whole = freq.agg(F.sum("n").alias("__all"))
    return freq.join(F.broadcast(whole)).select("sequence", F.col("n").alias("count"), F.round(F.col("n") / F.col("__all"), 4).alias("probability")).orderBy(F.desc("count"), "sequence").limit(limit)  # one row


def recommendations(measured: DataFrame) -> DataFrame:
    """What the metrics suggest; one row at least."""
    found = F.array_compact(F.array(
        F.when(F.col("confidence") < 0.5, "Confidence is low: train on more or more regular sequences."),
        F.when(F.col("states") > 1000, "There are many states: consider a lower order or merging rare tokens."),
        F.when(F.col("avg_probability") < 0.05, "Transitions are spread thin: consider fewer distinct tokens."),
    ))
    return measured.select(F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("The model looks healthy.")))).alias("recommendation"))


def period_start(as_of: datetime, period: str | None) -> datetime | None:
    """``12h``, ``7d``, ``2w`` back from ``as_of``; None for anything else."""
    m = re.fullmatch(r"(\d+)([hdw])", period or "")
    return as_of - timedelta(**{{"h": "hours", "d": "days", "w": "weeks"}[m[2]]: int(m[1])}) if m else None


def recent_anomalies(log: DataFrame, model_key: str, as_of: datetime, period: str | None = None, limit: int | None = 20) -> DataFrame:
    rows = log.where(F.col("model_key") == model_key)
    start = period_start(as_of, period)
    if start is not None:
        rows = rows.where(F.col("detected_at").between(start, as_of))
    newest = rows.orderBy(F.desc("detected_at"), "type", "sequence")
    return newest if limit is None else newest.limit(limit)


def build(model: Model, model_key: str, as_of: datetime, anomalies: DataFrame | None = None, sections: Sequence[str] = SECTIONS, period: str | None = None) -> dict[str, object]:
    """The chosen sections as plain values; every one is bounded (one row of metrics, five sequences, twenty anomalies)."""
    wanted = [s for s in SECTIONS if s in set(sections)] or list(SECTIONS)
    measured = metrics(model)
    out: dict[str, object] = {"model": model_key, "generated_at": as_of.isoformat()}
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if "summary" in wanted:
        out["summary"] = rows(measured)[0]
    if "predictions" in wanted:
        out["predictions"] = rows(top_sequences(model.sequence_freq))
    if "anomalies" in wanted:
        out["anomalies"] = rows(recent_anomalies(anomalies, model_key, as_of, period)) if anomalies is not None else []
    if "recommendations" in wanted:
        out["recommendations"] = [r["recommendation"] for r in rows(recommendations(measured))]
    return out


def _pairs(report: dict) -> list[tuple[str, str, str]]:
    out = []
    for section, body in report.items():
        if isinstance(body, dict):
            out += [(section, str(k), str(v)) for k, v in body.items()]
        elif isinstance(body, list):
            out += [(section, str(i), json.dumps(x, default=str) if isinstance(x, dict) else str(x)) for i, x in enumerate(body)]
        else:
            out.append(("report", section, str(body)))
    return out


def render(report: dict, kind: str = "markdown", template: str = "default") -> str:
    """json, markdown, html or csv (section, key, value); the ``executive`` template has the summary and recommendations only. There is no PDF: no library for it."""
    if template == "executive":
        report = {k: v for k, v in report.items() if k not in ("predictions", "anomalies")}
    if kind == "json":
        return json.dumps(report, indent=2, default=str)
    if kind == "csv":
        text = io.StringIO()
        csv.writer(text).writerows([("section", "key", "value"), *_pairs(report)])
        return text.getvalue()
    if kind == "html":
        rows = "".join(f"<tr><td>{html.escape(s)}</td><td>{html.escape(k)}</td><td>{html.escape(v)}</td></tr>" for s, k, v in _pairs(report))
        return f"<html><body><h1>Report</h1><table><tr><th>section</th><th>key</th><th>value</th></tr>{rows}</table></body></html>"
    if kind == "markdown":
        lines, last = ["# Report"], ""
        for s, k, v in _pairs(report):
            if s != last:
                lines += ["", f"## {s.title()}"]
                last = s
            lines.append(f"- {v}" if k.isdigit() else f"- {k}: {v}")
        return "\n".join(lines) + "\n"
    raise ValueError(f"no such format: {kind}")


def deliver(text: str, *channels: Callable[[str], None]) -> int:
    """Hand the text to every channel (a file, a mailer, a webhook); how many took it."""
    for send in channels:
        send(text)
    return len(channels)
