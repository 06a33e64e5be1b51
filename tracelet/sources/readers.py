"""Sources of training corpora. Every reader gives (seq_id, text) or records; none collects its data."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelet.functions.records import leaves


def numbered(texts: DataFrame) -> DataFrame:
    """(seq_id, text); blank and null texts are left out. Ids grow but have gaps."""
    return texts.where("text IS NOT NULL AND trim(text) <> ''").select(F.monotonically_increasing_id().alias("seq_id"), "text")


def corpus_from_values(spark: SparkSession, values: object) -> DataFrame:
    """Every scalar leaf of nested Python values as its own sequence; null and empty ones are dropped."""
    out: list[str] = []
    stack = [values]
    while stack:
        x = stack.pop()
        if isinstance(x, Mapping):
            stack += reversed(list(x.values()))
        elif isinstance(x, Iterable) and not isinstance(x, (str, bytes)):
            stack += reversed(list(x))
        elif x is not None and str(x) != "":
            out.append(("1" if x else "") if isinstance(x, bool) else str(x))
    return spark.createDataFrame(list(enumerate(x for x in out if x)), "seq_id long, text string")


def records_from_values(spark: SparkSession, values: object, schema: str | None = None) -> DataFrame:
    """A mapping is one record, a list of mappings several; anything else in a list is skipped."""
    rows = [values] if isinstance(values, Mapping) else [x for x in values if isinstance(x, Mapping)] if isinstance(values, Iterable) and not isinstance(values, (str, bytes)) else []
    if not rows:
        return spark.createDataFrame([], schema or "customer_id string")
    lines = spark.createDataFrame([(json.dumps(r, default=str),) for r in rows], "value string")
    if schema is None:  # one schema of all the records, inferred from them as an array
        schema = spark.range(1).select(F.schema_of_json(F.lit(json.dumps(rows, default=str)))).first()[0].removeprefix("ARRAY<").removesuffix(">")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def corpus_from_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Named columns, or all leaves of the records, each value a sequence."""
    return numbered(leaves(df.select(*columns) if columns else df))


def corpus_from_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Every trimmed cell that is not blank is a sequence; there is no header."""
    rows = spark.read.csv(path, header=False, sep=sep)
    return numbered(rows.select(F.explode(F.array(*[F.trim(c) for c in rows.columns])).alias("text")))


def corpus_from_json(spark: SparkSession, path: str) -> DataFrame:
    """All scalar leaves of JSON documents."""
    return numbered(leaves(spark.read.json(path, multiLine=True)))


def corpus_from_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.text(path).select(F.trim("value").alias("text")))


def corpus_from_column(df: DataFrame, column: str | Column) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return numbered(df.select(c.cast("string").alias("text")).where("text NOT IN ('', '0')"))


def corpus_from_table(spark: SparkSession, table: str, columns: list[str] | None = None) -> DataFrame:
    return corpus_from_frame(spark.table(table), columns)


def corpus_from_jdbc(spark: SparkSession, config: str, **options: str) -> DataFrame:
    """``url;table;column`` (or ``connection:table:column`` with ``url`` among the options); the filter and the column reach the database."""
    url, table, column = config.split(";") if ";" in config else (options.pop("url"), *config.split(":")[-2:])
    return numbered(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("text")))


def _get(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310
        if not 200 <= answer.status < 300:
            raise ValueError(f"{url} answered {answer.status}")
        return answer.read().decode()


def corpus_from_api(spark: SparkSession, url: str, get: Callable[[str], str] = _get) -> DataFrame:
    """All leaves of a JSON answer."""
    return corpus_from_values(spark, json.loads(get(url)))


def sequences_for_detection(spark: SparkSession, path: str) -> DataFrame:
    """A file that starts with ``[`` is a JSON array (inner arrays joined by blanks), any other has a sequence a line."""
    whole = spark.read.text(path, wholetext=True)
    text = F.trim("value")
    nested = F.transform(F.from_json(text, "array<array<string>>"), lambda a: F.array_join(a, " "))
    plain = F.from_json(text, "array<string>")
    is_json = F.startswith(text, F.lit("["))
    is_nested = text.rlike(r"^\[\s*\[")
    return numbered(whole.select(F.explode(F.when(is_json & is_nested, nested).when(is_json, plain).otherwise(F.split("value", r"\R"))).alias("text")))


READERS: dict[str, Callable[..., DataFrame]] = {"csv": corpus_from_csv, "json": corpus_from_json, "api": corpus_from_api, "database": corpus_from_jdbc, "table": corpus_from_table, "eloquent": corpus_from_table, "file": corpus_from_lines}


def load(spark: SparkSession, source: str, config: str | None) -> DataFrame:
    if source not in READERS:
        raise ValueError(f"unsupported source: {source}")
    if not config:
        raise ValueError(f"the source {source} needs a path or name")
    return READERS[source](spark, config)


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", token: str = "event_type", gap: str | None = None) -> DataFrame:
    """(key, session, tokens): events in order of time, cut at days, or at pauses of over ``gap``. A session is a group, so a key with many events is spread over its sessions once they are cut.

    Pauses are found within each day of a key; across days only the first and last time of each day are
    compared, so no task sorts all events of a key.
    """
    if gap is None:
        rows = events.withColumn("session", F.to_date(ts).cast("string"))
    else:
        pause = lambda before, after: F.coalesce(before < after - F.expr(f"INTERVAL {gap}"), F.lit(False)).cast("int")
        daily = events.withColumn("__day", F.coalesce(F.to_date(ts), F.lit("0001-01-01").cast("date")))
        w = Window.partitionBy(key, "__day").orderBy(ts, tie)
        cut = daily.withColumn("__new", pause(F.lag(ts).over(w), F.col(ts)))
        cut = cut.withColumn("__within", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        days = cut.groupBy(key, "__day").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.sum("__new").alias("__cuts"))
        order = Window.partitionBy(key).orderBy("__day")  # a row for each day of a key
        days = days.withColumn("__begins", pause(F.max("__last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__first")))
        days = days.withColumn("__base", F.col("__begins") + F.coalesce(F.sum(F.col("__cuts") + F.col("__begins")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows = cut.withColumnRenamed(key, "__key").join(days.select(key, F.col("__day").alias("__d"), "__base"), F.col("__key").eqNullSafe(F.col(key)) & (F.col("__day") == F.col("__d")))
        rows = rows.withColumn("session", (F.col("__base") + F.col("__within")).cast("string"))
    grouped = rows.groupBy(key, "session").agg(F.array_sort(F.collect_list(F.struct(ts, tie, token))).alias("e"))
    return grouped.select(key, "session", F.transform("e", lambda x: x[token]).alias("tokens"))


def reconstructed(freq: DataFrame) -> DataFrame:
    """Sequences repeated as often as they occurred, for sources that want rows; models take the counts as weights instead."""
    return numbered(freq.select(F.explode(F.array_repeat("sequence", F.col("n").cast("int"))).alias("text")))


def trained_entities(entities: DataFrame, models: DataFrame, keys: tuple[str, str] = ("type", "id"), with_model: bool = False) -> DataFrame:
    """Entities that have a stored model, or all with theirs."""
    m = models.select(F.col("entity_type").alias(keys[0]), F.col("entity_id").alias(keys[1]), *(["model_key"] if with_model else [])).distinct()
    return entities.join(m, list(keys), "left" if with_model else "left_semi")


