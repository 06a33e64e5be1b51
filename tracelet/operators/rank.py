"""PageRank over weighted edges by power iteration, and what is read off the ranks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracelet.functions.staging import discard, staged
from tracelet.functions.text import group_key, next_prefix
from tracelet.operators.cluster import positions
from tracelet.operators.model import Model

DAMPING, THRESHOLD, ITERATIONS = 0.85, 1e-6, 100
#: Edges of a source in one place, and the most places that they are dealt to.
HUB, MOST_PLACES = 100_000, 4096


def normalize(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges with the share of their source): edges of positive weight; every source counts as a node, every target of a positive edge too."""
    ids = edges.select(F.col("src").alias("id")).union(edges.where("weight > 0").select(F.col("dst").alias("id")))
    if nodes is not None:
        ids = ids.union(nodes.select("id"))
    summed = edges.where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = summed.groupBy("src").agg(F.sum("weight").alias("out"), F.count(F.lit(1)).alias("degree"))
    # the edges of a hub are dealt to so many places; its rank goes to each of them
    places = F.when(F.col("degree") > HUB, F.least(F.lit(MOST_PLACES), F.ceil(F.col("degree") / HUB))).otherwise(1).cast("int")
    shares = summed.join(out.withColumn("places", places), "src").select("src", F.pmod(F.xxhash64("dst"), "places").cast("int").alias("place"), "dst", (F.col("weight") / F.col("out")).alias("share"), "places")
    return ids.where("id IS NOT NULL").distinct(), shares


def step(edges: DataFrame, ranks: DataFrame, n: int, damping: float) -> DataFrame:
    """One iteration: (id, rank, places, delta). ``places``: of the node's edges; 0 for a node that leads nowhere, whose rank is spread over all nodes."""
    lost = ranks.where("places = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
    sent = ranks.where("places > 0").select(F.col("id").alias("src"), "rank", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    flow = edges.join(sent, ["src", "place"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
    new = F.lit((1 - damping) / n) + damping * F.coalesce("flow", F.lit(0.0)) + damping * F.col("lost") / n
    return ranks.join(flow, "id", "left").join(F.broadcast(lost)).select("id", new.alias("rank"), "places", F.abs(new - F.col("rank")).alias("delta"))  # lost: one row


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = DAMPING, threshold: float = THRESHOLD, max_iterations: int = ITERATIONS, check: bool = True) -> tuple[DataFrame, int, bool]:
    """(ranks (id, rank), iterations, converged). Parameters out of range are put right; ``check`` False runs all iterations.

    Nodes, edges and ranks are written to the shared folder, so plans stay short; ranks that newer ones
    have replaced are deleted. The edges are also held on the executors, dealt by their source, so an
    iteration shuffles ranks and flows but no edge; executors that are lost read them again.
    """
    damping, threshold, max_iterations = (damping if 0 < damping < 1 else DAMPING), (threshold if threshold > 0 else THRESHOLD), max(1, max_iterations)
    ids, shares = normalize(edges, nodes)
    stored = staged(shares, "edges")
    ids = staged(ids, "nodes")
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("rank")), 0, True
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stored.drop("places").repartition(parts, "src", "place").persist()
    out = stored.select(F.col("src").alias("id"), "places").distinct()
    old, ranks = None, ids.join(out, "id", "left").select("id", F.lit(1.0 / n).alias("rank"), F.coalesce("places", F.lit(0)).alias("places"))
    done = False
    try:
        for i in range(1, max_iterations + 1):
            seen = Observation()
            new = step(held, ranks, n, damping)
            if check:  # the largest change is observed while the ranks are written, which saves a pass
                new = new.observe(seen, F.max("delta").alias("delta"))
            elif i % 2 and i < max_iterations:
                ranks = new.drop("delta")
                continue
            new = staged(new, f"rank{i}")
            discard(old)
            old, ranks = new, new.drop("delta")
            if check and seen.get["delta"] <= threshold:
                done = True
                break
    finally:
        held.unpersist()
    return ranks.select("id", "rank"), i, done


def model_edges(model: Model, graph: str = "model") -> DataFrame:
    """``model``: from prefixes to tokens with their probabilities; ``state``: from prefix to prefix, for orders above one."""
    t = model.transitions
    if graph == "state":
        return t.select(F.col("prefix").alias("src"), next_prefix(F.col("prefix"), F.col("token"), model.order).alias("dst"), F.col("probability").alias("weight")).where("dst IS NOT NULL")
    return t.select(F.col("prefix").alias("src"), F.col("token").alias("dst"), F.col("probability").alias("weight"))


def normalized_scores(ranks: DataFrame) -> DataFrame:
    """Append normalized_score: 0 to 100 between the smallest and the largest rank; where all are equal, each one's share of the sum."""
    ends = ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.sum("rank").alias("sum"))
    spread = F.col("hi") - F.col("lo")
    score = F.when(spread > 1e-12, (F.col("rank") - F.col("lo")) / spread * 100).when(F.col("sum") > 0, F.col("rank") / F.col("sum") * 100).otherwise(0.0)
    return ranks.join(F.broadcast(ends)).withColumn("normalized_score", score).drop("lo", "hi", "sum")  # ends: one row


def percentiles(ranks: DataFrame) -> DataFrame:
    """Append percentile by place: 100 for the highest rank down to 0; ties by node, so they differ."""
    n = ranks.agg(F.count(F.lit(1)).alias("n"))
    placed = positions(ranks, F.desc("rank"), "id")
    return placed.join(F.broadcast(n)).withColumn("percentile", 100 - F.col("position") / F.greatest(F.lit(1), F.col("n") - 1) * 100).drop("n")  # n: one row


@dataclass(frozen=True)
class RankResult:
    """``groups``: (group_key, position, node), a row for each node returned, so a group may be as large as the graph."""

    nodes: DataFrame
    groups: DataFrame | None
    metadata: dict[str, object] | None


def analyze(edges: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD, max_iterations: int = ITERATIONS, top: int | None = None, group_by: str | Callable[[Column], Column] | None = None, include_metadata: bool = True, nodes: DataFrame | None = None) -> RankResult:
    """Ranks with scores and percentiles over all nodes, then the ``top`` ones; groups cover the nodes returned."""
    ranks, turns, converged = pagerank(edges, nodes, damping, threshold, max_iterations)
    scored = percentiles(normalized_scores(ranks))
    out = scored.select(F.col("id").alias("node"), F.round("rank", 6).alias("raw_score"), F.round("normalized_score", 2).alias("normalized_score"), F.round("percentile", 1).alias("percentile"), "position")
    if group_by is not None:
        out = out.withColumn("group_key", group_key(F.col("node"), group_by))
    if top is not None:
        out = out.where(F.col("position") < top)
    groups = None
    if group_by is not None:
        groups = out.select("group_key", "position", "node")
    info = {"damping": damping, "threshold": threshold, "iterations": turns, "converged": converged, "top": top} if include_metadata else None
    return RankResult(out, groups, info)


@dataclass(frozen=True)
class _Settings:
    damping: float = DAMPING
    threshold: float = THRESHOLD
    max_iterations: int = ITERATIONS
    top: int | None = None
    group_by: str | Callable[[Column], Column] | None = None
    edges: DataFrame | None = None
    build: Callable[[Model], DataFrame] | None = None


class PageRankBuilder:
    """Settings of one ranking; the result is kept until a setting changes."""

    def __init__(self, model: Model) -> None:
        self.model, self.settings, self.with_metadata, self.last = model, _Settings(), True, None

    def _set(self, **changes) -> PageRankBuilder:
        self.settings, self.last = replace(self.settings, **changes), None
        return self

    def damping_factor(self, value: float) -> PageRankBuilder:
        if not 0 < value < 1:
            raise ValueError("the damping factor lies between 0 and 1")
        return self._set(damping=value)

    def convergence_threshold(self, value: float) -> PageRankBuilder:
        if value <= 0:
            raise ValueError("the threshold is positive")
        return self._set(threshold=value)

    def max_iterations(self, n: int) -> PageRankBuilder:
        if n < 1:
            raise ValueError("there is at least one iteration")
        return self._set(max_iterations=n)

    def top_nodes(self, n: int | None) -> PageRankBuilder:
        if n is not None and n < 1:
            raise ValueError("there is at least one node")
        return self._set(top=n)

    def include_metadata(self, yes: bool = True) -> PageRankBuilder:
        self.with_metadata = yes
        return self

    def group_by(self, by: str | Callable[[Column], Column] | None) -> PageRankBuilder:
        return self._set(group_by=by)

    def with_graph(self, edges: DataFrame) -> PageRankBuilder:
        return self._set(edges=edges)

    def use_graph_builder(self, build: Callable[[Model], DataFrame]) -> PageRankBuilder:
        return self._set(build=build)

    def calculate(self) -> RankResult:
        if self.last is None:
            s = self.settings
            edges = s.edges if s.edges is not None else s.build(self.model) if s.build else model_edges(self.model)
            self.last = analyze(edges, s.damping, s.threshold, s.max_iterations, s.top, s.group_by)
        return self.last if self.with_metadata else replace(self.last, metadata=None)

    result = calculate

    def reset(self) -> PageRankBuilder:
        self.settings, self.last = _Settings(), None
        return self
