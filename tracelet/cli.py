"""Command line: train, generate, analyze, pagerank, detect-anomalies, snapshot, schedule, report."""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelet.functions.text import format_bytes
from tracelet.operators import model, report
from tracelet.operators.schedule import next_run
from tracelet.plans.chain import EngineConfig, Manager
from tracelet.schema import TABLES
from tracelet.sources import readers, sinks


def cache_key(name: str, tag: str | None, cache: bool) -> str | None:
    """``model:tag``, or ``model:latest``; None where nothing is to be kept."""
    return f"{name}:{tag or 'latest'}" if tag or cache else None


def meta_pairs(items: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in items if "=" in x)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelet", description=__doc__)
    p.add_argument("--root", required=True, help="folder of stored models, logs and schedules")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("train")
    one.add_argument("model")
    one.add_argument("--source", default="file", choices=sorted(readers.READERS))
    one.add_argument("--data", required=True)
    one.add_argument("--order", type=int, default=2)
    one.add_argument("--tag")
    one.add_argument("--cache", action="store_true")
    one.add_argument("--incremental", action="store_true")
    one.add_argument("--ttl", type=int)
    one.add_argument("--meta", action="append", default=[])
    one.add_argument("--notify", action="append", default=[])
    one = sub.add_parser("generate")
    one.add_argument("key")
    one.add_argument("--words", type=int, default=100)
    one.add_argument("--walks", type=int, default=1)
    one.add_argument("--seed")
    one.add_argument("--output")
    one = sub.add_parser("analyze")
    one.add_argument("key")
    one.add_argument("--profile", default="text")
    one.add_argument("--seed")
    one.add_argument("--limit", type=int, default=3)
    one.add_argument("--from", dest="since")
    one.add_argument("--to")
    one.add_argument("--export")
    one = sub.add_parser("pagerank")
    one.add_argument("key")
    one.add_argument("--damping", type=float, default=0.85)
    one.add_argument("--threshold", type=float, default=1e-6)
    one.add_argument("--iterations", type=int, default=100)
    one.add_argument("--top", type=int)
    one.add_argument("--group-by")
    one.add_argument("--export")
    one.add_argument("--snapshot", action="store_true")
    one.add_argument("--tag")
    one = sub.add_parser("detect-anomalies")
    one.add_argument("key")
    one.add_argument("--input", required=True)
    one.add_argument("--threshold", type=float, default=0.05)
    one.add_argument("--log")
    one = sub.add_parser("snapshot")
    one.add_argument("key")
    one.add_argument("--tag", required=True)
    one.add_argument("--description")
    one.add_argument("--compress", action="store_true")
    one.add_argument("--encrypt", action="store_true")
    one.add_argument("--export")
    one.add_argument("--password")
    one = sub.add_parser("schedule")
    one.add_argument("action", nargs="?")
    one.add_argument("--list", action="store_true")
    one.add_argument("--model")
    one.add_argument("--frequency", default="daily", choices=["hourly", "daily", "weekly", "monthly", "cron"])
    one.add_argument("--time")
    one.add_argument("--cron")
    one.add_argument("--disabled", action="store_true")
    one = sub.add_parser("report")
    one.add_argument("key")
    one.add_argument("--format", default="markdown", choices=["json", "markdown", "html", "csv"])
    one.add_argument("--sections", default=",".join(report.SECTIONS))
    one.add_argument("--period")
    one.add_argument("--template", default="default", choices=["default", "executive"])
    one.add_argument("--log")
    one.add_argument("--save")
    return p


SHOWN = 100


def listed(rows, show, whole: str | None) -> None:
    """Show the first rows, and say so when there are more."""
    found = rows.limit(SHOWN + 1).collect()
    for r in found[:SHOWN]:
        show(r)
    if len(found) > SHOWN:
        print(f"the first {SHOWN} are shown" + (f"; {whole} writes all" if whole else ""), file=sys.stderr)


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a = parser().parse_args(args)
    out = out or sys.stdout
    say = lambda *x: print(*x, file=out)
    spark = spark or SparkSession.builder.appName("tracelet").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    manager = Manager(spark, EngineConfig(storage="file", root=a.root))
    now = datetime.now()
    try:
        if a.command == "train":
            began = time.time()
            chain = manager.chain().order(a.order).incremental(a.incremental)
            key = cache_key(a.model, a.tag, a.cache or a.incremental)
            chain = chain.cache(key) if key else chain
            chain.train_from(a.source, a.data)
            if key:
                chain.save(key, a.ttl, **meta_pairs(a.meta))
            facts = chain.get_model_meta().first().asDict()
            say(json.dumps({"model": key or a.model, "seconds": round(time.time() - began, 1), "size": format_bytes(facts["transitions"] * 32)} | facts))
            sinks.notify(facts, *[sinks.to_webhook(url) for url in a.notify])
        elif a.command == "generate":
            made = manager.chain().load(a.key).generate(a.words, seed=a.seed, walks=a.walks)
            if a.output:
                sinks.write_texts(made, a.output)
            else:
                listed(made.orderBy("walk"), lambda r: say(r["text"]), "--output")
        elif a.command == "analyze":
            made = manager.chain().load(a.key).analyzer(a.profile).from_date_range(a.since, a.to).predict(a.seed, a.limit)
            if a.export:
                sinks.export_predictions(made, a.export)
            else:
                listed(made, lambda r: say(json.dumps(r.asDict(), default=str)), "--export")
        elif a.command == "pagerank":
            chain = manager.chain().load(a.key)
            made = chain.analyze("pagerank", damping=a.damping, threshold=a.threshold, iterations=a.iterations, top=a.top, group_by=a.group_by)
            if a.snapshot:
                sinks.rank_snapshot(made, a.key, a.tag, now).write.mode("append").parquet(f"{a.root}/_ranks")
            if a.export:
                sinks.export_ranks(made, a.export, "csv" if a.export.endswith(".csv") else "json")
            else:
                listed(made.nodes.orderBy("position"), lambda r: say(json.dumps(r.asDict())), "--export")
        elif a.command == "detect-anomalies":
            found = manager.chain().train(readers.sequences_for_detection(spark, a.input)).detect(a.key).unseen_sequences().emerging_patterns().drift().threshold(a.threshold).order_by("score").get()
            if a.log:
                sinks.append_anomalies(found, a.log, a.key, now)
            listed(found, lambda r: say(json.dumps(r.asDict(), default=str)), "--log")
        elif a.command == "snapshot":
            store = manager.storage()
            if a.encrypt and not a.password:
                raise ValueError("--encrypt needs a --password")
            store.snapshot(a.key, a.tag, a.description, now, "gzip" if a.compress else None, a.password if a.encrypt else None)
            if a.export:
                store.export(a.key, a.export, password=a.password)
            say(f"{a.key} kept as {a.tag}")
        elif a.command == "schedule":
            where = f"{a.root}/_schedules"
            if a.action:
                at = next_run(now, a.frequency, a.time, a.cron, not a.disabled)
                row = (str(uuid.uuid4()), a.action, a.model, a.frequency, a.time, a.cron, None, not a.disabled, None, at, None, now)
                spark.createDataFrame([row], TABLES["schedules"]).write.mode("append").parquet(where)
                say(f"{a.action} runs next at {at}")
            if a.list:
                listed(spark.read.schema(TABLES["schedules"]).parquet(where).orderBy(F.desc("created_at")), lambda r: say(r["action"], r["model_key"], r["frequency"], r["next_run_at"]), None)
        elif a.command == "report":
            found = manager.chain().load(a.key).model()
            log = sinks.read_log(spark, a.log) if a.log else None
            text = report.render(report.build(model.Model(found.order, found.transitions, found.sequence_freq), a.key, now, log, a.sections.split(","), a.period), a.format, a.template)
            if a.save:
                spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.save)
            else:
                say(text)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
