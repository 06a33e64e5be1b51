"""The fluent face of the library: a manager, chains, and builders for predictors.

A chain collects settings and data; nothing runs before a result is asked for. Training fixes the
order; saving and loading are separate, so asking a stored model never overwrites it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelet.operators import churn, cluster, detect, forecast, generate, ltv, model, nba, predict, rank
from tracelet.sources import readers, sinks
from tracelet.sources.store import ParquetStore, SessionStore, Storage, export_model


@dataclass
class EngineConfig:
    order: int = 2
    walk_length: int = 100
    ttl: int = 3600
    storage: str = "session"
    root: str | None = None
    threshold: float = 0.05
    extra: dict = field(default_factory=dict)

    def get(self, name: str, default: object = None) -> object:
        return getattr(self, name, self.extra.get(name, default))


Analyzer = Callable[["Chain", dict], object]
Generator = Callable[["Chain", int, dict], DataFrame]
Predictor = Callable[["Predictive", dict], DataFrame]


def _text(chain: Chain, options: dict) -> DataFrame:
    return predict.predict(chain.model(), chain.seed_rows(options.get("seed")), limit=options.get("limit", 3))


def _navigation(chain: Chain, options: dict) -> DataFrame:
    return predict.navigation(_text(chain, options), **{k: options.get(k) for k in ("from", "to", "label")})


def _pagerank(chain: Chain, options: dict) -> rank.RankResult:
    edges = options.get("graph")
    build = options.get("graph_builder")
    edges = build(chain.model()) if edges is None and build else edges
    names = {"damping": ("damping", "damping_factor"), "threshold": ("threshold", "convergence_threshold"), "max_iterations": ("max_iterations", "iterations"), "top": ("top",), "group_by": ("group_by",), "include_metadata": ("include_metadata",)}
    given = {k: options[n] for k, alias in names.items() for n in alias if n in options}
    return rank.analyze(rank.model_edges(chain.model()) if edges is None else edges, **given)


class Manager:
    """Makes chains; holds the registered analyzers, generators, storages and builders."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None) -> None:
        self.spark, self.config = spark, config or EngineConfig()
        self.analyzers: dict[str, Analyzer] = {"text": _text, "navigation": _navigation, "pagerank": _pagerank}
        self.generators: dict[str, Generator] = {
            "text": lambda c, n, o: generate.as_text(c.walk(n, o)),
            "sequence": lambda c, n, o: generate.as_json(c.walk(n, o)) if o.get("as_array") else generate.as_text(c.walk(n, o)),
        }
        self.predictors: dict[str, Predictor] = {
            "churn": lambda p, o: p.churn_score(**o), "ltv": lambda p, o: p.ltv(**o),
            "next_best_action": lambda p, o: p.next_best_action(**o), "forecast": lambda p, o: p.seasonal_forecast(**o),
        }
        self.storages: dict[str, Storage] = {"session": SessionStore()}
        if self.config.root:
            self.storages["database"] = self.storages["file"] = ParquetStore(spark, self.config.root)
        self.builders: dict[str, Callable[[Manager], object]] = {"text": lambda m: Chain(m, "text"), "analytics": lambda m: Chain(m, "navigation"), "navigation": lambda m: Chain(m, "navigation")}

    def chain(self, context: str = "text"):
        return self.builders[context](self) if context in self.builders else Chain(self, context)

    def extend_predictor(self, name: str, fn: Predictor) -> Manager:
        self.predictors[name] = fn
        return self

    def predictor(self, name: str) -> Predictor:
        return self._named(self.predictors, name)

    def predictive(self, key: str | None = None, **options) -> Predictive:
        chain = Chain(self)
        return Predictive(chain.load(key) if key else chain, options)

    def _named(self, table: dict, name: str):
        if name not in table:
            raise ValueError(f"there is no {name}; known: {', '.join(sorted(table))}")
        return table[name]

    def analyzer(self, name: str) -> Analyzer:
        return self._named(self.analyzers, name)

    def generator(self, name: str) -> Generator:
        return self._named(self.generators, name)

    def storage(self, name: str | None = None) -> Storage:
        return self._named(self.storages, name or self.config.storage)

    def has_analyzer(self, name: str) -> bool:
        return name in self.analyzers

    def extend_analyzer(self, name: str, fn: Analyzer) -> Manager:
        self.analyzers[name] = fn
        return self

    extend = extend_analyzer

    def extend_generator(self, name: str, fn: Generator) -> Manager:
        self.generators[name] = fn
        return self

    def extend_storage(self, name: str, storage: Storage) -> Manager:
        self.storages[name] = storage
        return self

    def extend_builder(self, name: str, fn: Callable[[Manager], object]) -> Manager:
        self.builders[name] = fn
        return self


class Chain:
    """One model with its data and settings."""

    _pool = ThreadPoolExecutor(4)

    def __init__(self, manager: Manager, context: str = "text") -> None:
        self.manager, self.spark = manager, manager.spark
        self._context, self._order, self._options = context, manager.config.order, {}
        self._analyzer: str | None = None
        self._storage: str | None = None
        self._key: str | None = None
        self._incremental = self._debug = False
        self._probabilities = True
        self._channel: Callable[[DataFrame], None] | None = None
        self._sequences: DataFrame | None = None
        self._model: model.Model | None = None
        self._records: DataFrame | None = None
        self.last_generated: DataFrame | None = None
        self.last_analysis: object = None
        self.events: list[tuple[str, dict]] = []

    # ------------------------------------------------ settings
    def context(self, name: str) -> Chain:
        self._context = name
        return self

    def order(self, k: int) -> Chain:
        """Of the next training; a trained model keeps its own."""
        self._order = model.checked_order(k)
        return self

    def incremental(self, yes: bool = True) -> Chain:
        self._incremental = yes
        return self

    def use_storage(self, name: str) -> Chain:
        self._storage = name
        return self

    def cache(self, key: str) -> Chain:
        """Where incremental training looks, and where ``save`` writes."""
        self._key = key
        return self

    def option(self, name: str, value: object) -> Chain:
        self._options[name] = value
        return self

    def options(self, **values) -> Chain:
        self._options |= values
        return self

    def analyzer(self, name: str) -> Chain:
        self._analyzer = name
        return self

    def with_probabilities(self, yes: bool = True) -> Chain:
        self._probabilities = yes
        return self

    def broadcast(self, listener: Callable[[DataFrame], None]) -> Chain:
        self._channel = listener
        return self

    def debug(self, yes: bool = True) -> Chain:
        self._debug = yes
        return self

    def seed(self, text: str) -> Chain:
        return self.option("seed", text)

    start_with = seed

    def from_date_range(self, start: str | None, end: str | None) -> Chain:
        return self.options(**{"from": start, "to": end})

    def for_label(self, label: str) -> Chain:
        return self.option("label", label)

    def when(self, yes: object, then: Callable[[Chain], object], otherwise: Callable[[Chain], object] | None = None) -> Chain:
        fn = then if yes else otherwise
        return (fn(self) if fn else None) or self

    def unless(self, yes: object, then: Callable[[Chain], object]) -> Chain:
        return self.when(not yes, then)

    # ------------------------------------------------ training
    def train(self, data: DataFrame | Iterable | str, columns: list[str] | None = None, as_of: datetime | None = None) -> Chain:
        """From a table with a column ``tokens`` or ``text``, from records (every leaf a sequence, or named columns), or from Python values."""
        if isinstance(data, DataFrame):
            self._records = data
            if "tokens" in data.columns and not columns:
                rows = data
            elif "text" in data.columns and not columns:
                rows = model.token_rows(data)
            else:
                rows = model.token_rows(readers.corpus_from_frame(data, columns))
        else:
            rows = model.token_rows(readers.corpus_from_values(self.spark, data))
            records = [x for x in ([data] if isinstance(data, Mapping) else data if not isinstance(data, str) else []) if isinstance(x, Mapping)]
            self._records = readers.records_from_values(self.spark, records) if records else None
        self._sequences, made = rows, model.train(rows, self._order)
        stored = self.manager.storage(self._storage).get(self._key, as_of) if self._incremental and self._key else None
        self._model = made if stored is None else model.merge(stored, made)
        self.events.append(("model_trained", {"key": self._key, "order": self._model.order}))
        return self

    def train_from(self, source: str, config: str) -> Chain:
        return self.train(readers.load(self.spark, source, config))

    def save(self, key: str | None = None, ttl: int | None = None, as_of: datetime | None = None, **meta) -> Chain:
        self._key = key or self._key
        self.manager.storage(self._storage).put(self._key, self.model(), ttl if ttl is not None else self.manager.config.ttl, as_of, {**self._options.get("meta", {}), **meta}, self._records)
        return self

    def load(self, key: str, as_of: datetime | None = None) -> Chain:
        found = self.manager.storage(self._storage).get(key, as_of)
        if found is None:
            raise ValueError(f"there is no model {key}")
        self._key, self._model = key, found
        self._order = found.order
        return self

    def model(self) -> model.Model:
        if self._model is None:
            if self._key is None:
                raise ValueError("the chain has no model: train or load one")
            self.load(self._key)
        return self._model

    # ------------------------------------------------ results
    def seed_rows(self, seed: object = None) -> DataFrame:
        seed = self._options.get("seed") if seed is None else seed
        if isinstance(seed, DataFrame):
            return seed
        return self.spark.createDataFrame([(s,) for s in (seed if isinstance(seed, (list, tuple)) else [seed])], "seed string")

    def walk(self, length: int, options: Mapping) -> DataFrame:
        n, seed = int(options.get("walks", 1)), options.get("seed", self._options.get("seed"))
        starts = self.spark.range(n).select(F.col("id").alias("walk"), F.lit(seed).cast("string").alias("s"))
        return generate.walks(self.model(), starts, length, int(options.get("random_seed", 1)), start="s")

    def generate(self, length: int | None = None, **options) -> DataFrame:
        kind = options.pop("generator", "text")
        self.last_generated = self.manager.generator(kind)(self, self.manager.config.walk_length if length is None else length, {**self._options, **options})
        self.events.append(("content_generated", {"generator": kind}))
        return self.last_generated

    def generate_sequence(self, length: int, **options) -> DataFrame:
        return self.generate(length, generator="sequence", **options)

    def _resolved(self) -> str:
        for name in (self._analyzer, self._context):
            if name and self.manager.has_analyzer(name):
                return name
        return "text"

    def analyze(self, subject: object = None, **options) -> object:
        """A subject that names an analyzer selects it; any other is trained on where there is no model yet."""
        name = subject if isinstance(subject, str) and self.manager.has_analyzer(subject) else self._resolved()
        if subject is not None and subject is not name and self._model is None:
            self.train(subject)
        self.last_analysis = self.manager.analyzer(name)(self, {**self._options, **options})
        return self.last_analysis

    def predict(self, seed: object = None, limit: int = 3, **options) -> DataFrame:
        made = self.manager.analyzer(self._resolved())(self, {**self._options, **options, "seed": seed, "limit": limit})
        if self._channel is not None:
            self._channel(made)
            self.events.append(("prediction_made", {"limit": limit}))
        if self._probabilities or not isinstance(made, DataFrame):
            return made
        return made.drop("probability", "confidence")

    def detect(self, baseline_key: str, current: DataFrame | Iterable | None = None) -> detect.AnomalyDetector:
        base = self.manager.storage(self._storage).get(baseline_key)
        if base is None:
            raise ValueError(f"there is no baseline {baseline_key}")
        if current is not None:
            self.train(current)
        if self._model is None:
            raise ValueError("there are no current sequences")
        return detect.AnomalyDetector(detect.Context(base, self.model().sequence_freq), detect.Config(threshold=self.manager.config.threshold))

    def detect_seasonality(self, baseline_key: str, profile: DataFrame) -> DataFrame:
        return self.detect(baseline_key).seasonality_data(profile).detect_seasonality().get()

    def cluster(self, baseline_key: str | None = None, algorithm: str = "kmeans", clusters: int = 3) -> dict[str, DataFrame]:
        """Profiles of the current clusters, and with a baseline whether they have shifted."""
        now = self.model().sequence_freq
        out = {"profiles": cluster.profiles(cluster.assign(now, algorithm, clusters))}
        if baseline_key is not None:
            old = self.manager.storage(self._storage).get(baseline_key)
            if old is None:
                raise ValueError(f"there is no baseline {baseline_key}")
            out["baseline"] = cluster.profiles(cluster.assign(old.sequence_freq, algorithm, clusters), now)
            out["shift"] = cluster.shift(out["baseline"], out["profiles"])
        return out

    def monitor(self, baseline_key: str) -> detect.Monitor:
        return detect.Monitor(self.detect(baseline_key))

    def page_rank(self) -> rank.PageRankBuilder:
        return rank.PageRankBuilder(self.model())

    def generate_async(self, length: int | None = None, **options) -> Future:
        return self._pool.submit(self.generate, length, **options)

    def analyze_async(self, subject: object = None, **options) -> Future:
        return self._pool.submit(self.analyze, subject, **options)

    def queue(self, job: Callable[[Chain], object]) -> Future:
        return self._pool.submit(job, self)

    # ------------------------------------------------ what it holds
    def to_probabilities(self) -> DataFrame:
        return self.model().transitions

    get_transition_matrix = to_probabilities

    def to_dict(self) -> dict:
        return {"order": self.model().order, "context": self._context, "key": self._key, "options": {k: v for k, v in self._options.items() if not isinstance(v, DataFrame)}}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    def export(self, path: str) -> Chain:
        export_model(self.model(), path)
        return self

    def explain(self) -> str:
        return self.model().transitions._jdf.queryExecution().toString()

    def probability_of(self, sequences: DataFrame | Iterable[str]) -> DataFrame:
        rows = sequences if isinstance(sequences, DataFrame) else self.spark.createDataFrame([(s,) for s in sequences], "sequence string")
        return predict.sequence_probability(self.model(), rows)

    def get_sequence_frequencies(self) -> DataFrame:
        return self.model().sequence_freq

    def get_model_meta(self) -> DataFrame:
        return model.metrics(self.model())

    def get_corpus(self) -> DataFrame | None:
        return self._sequences

    def get_records(self) -> DataFrame | None:
        store = self.manager.storage(self._storage)
        if self._records is None and self._key and hasattr(store, "records"):
            self._records = store.records(self._key)
        return self._records

    def with_records(self, records: DataFrame) -> Chain:
        self._records = records
        return self

    def get_order(self) -> int:
        return self._model.order if self._model else self._order

    def get_context(self) -> str:
        return self._context

    def get_analyzer(self) -> str | None:
        return self._analyzer

    def get_options(self) -> dict:
        return dict(self._options)

    def get_cache_key(self) -> str | None:
        return self._key

    def get_storage_name(self) -> str:
        return self._storage or self.manager.config.storage

    def get_manager(self) -> Manager:
        return self.manager

    def get_last_generated(self) -> DataFrame | None:
        return self.last_generated

    def get_last_analysis(self) -> object:
        return self.last_analysis


class Predictive:
    """Predictors over customer records, beside a baseline model."""

    def __init__(self, chain: Chain, options: dict | None = None, records: DataFrame | None = None) -> None:
        self.chain, self.options, self.records = chain, dict(options or {}), records

    def using_options(self, **options) -> Predictive:
        return Predictive(self.chain, {**self.options, **options}, self.records)

    def dataset(self, records: DataFrame | Iterable[Mapping]) -> Predictive:
        rows = records if isinstance(records, DataFrame) else readers.records_from_values(self.chain.spark, records)
        return Predictive(self.chain, self.options, rows)

    def baseline(self) -> model.Model:
        return self.chain.model()

    def predict(self, name: str, **settings) -> DataFrame:
        """By the predictor of that name, the library's own or a registered one."""
        return self.chain.manager.predictor(name)(self, settings)

    def _rows(self) -> DataFrame | None:
        return self.records if self.records is not None else self.chain.get_records()

    def _some(self) -> DataFrame:
        rows = self._rows()
        return readers.records_from_values(self.chain.spark, []) if rows is None else rows

    def churn_score(self, **settings) -> DataFrame:
        """Without records, stand-ins made of the baseline's sequences."""
        rows = self._rows()
        rows = churn.fallback_customers(self.baseline().sequence_freq) if rows is None else rows
        return churn.churn(rows, **{**self.options.get("churn", {}), **settings})

    def ltv(self, **settings) -> DataFrame:
        """Of no records, no predictions."""
        return ltv.ltv(self._some(), **{**self.options.get("ltv", {}), **settings})

    def next_best_action(self, customer_id: str | None = None, **settings) -> DataFrame:
        rows = self._some()
        if customer_id is not None:
            rows = nba.for_customer(rows, customer_id)
        return nba.next_best_actions(self.baseline(), rows, **{**self.options.get("next_best_action", {}), **settings})

    def seasonal_forecast(self, metric: str = "value", series: DataFrame | None = None, as_of: datetime | None = None, **settings) -> DataFrame:
        """From a given series, else the points embedded in the records, else one a day from the baseline's sequences."""
        points = forecast.series(series, metric) if series is not None else None
        if points is None and (rows := self._rows()) is not None:
            points = forecast.embedded_series(rows, metric)
            points = points if not points.isEmpty() else None
        if points is None:
            points = forecast.fallback_series(self.baseline().sequence_freq, as_of or datetime.now())
        return forecast.forecast(points, **{**self.options.get("forecast", {}), **settings})


def suggestions(actions: DataFrame, *channels: sinks.Channel, limit: int | None = None) -> int:
    """Hand all recommended actions to channels, a partition at a time. With ``limit``, more actions than that are an error and none is sent."""
    if limit is None:
        return sum(sinks.notify(r.asDict(recursive=True), *channels) for r in actions.toLocalIterator())
    rows = actions.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} actions")
    return sum(sinks.notify(r.asDict(recursive=True), *channels) for r in rows)


