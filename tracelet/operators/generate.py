"""Seeded random walks over a model, all walks in step.

The uniform number of (seed, walk, step) is the head of an MD5, so walks are the same on any engine
and however rows are dealt. A step takes the token whose interval of the running probability holds it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.functions.staging import discard, staged
from tracelet.functions.text import let, next_prefix, seed_prefix, start_prefix
from tracelet.operators.cluster import running_before
from tracelet.operators.model import Model
from tracelet.schema import END

#: Tokens in a block; blocks of a model that is broadcast whole; share of all steps that makes a block hot.
BLOCK, SMALL, HOT = 256, 4096, 512
#: Steps between two tables of walks.
STRIDE = 8


def uniform(seed: int, walk: Column, step: int) -> Column:
    head = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), walk.cast("string"), F.lit(str(step)))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / 4294967296.0


def intervals(model: Model) -> DataFrame:
    """(prefix, block, choices, weight): the tokens of a prefix in ascending order, BLOCK of them to a row, with the upper ends of their intervals, and how often they followed.

    Upper ends come from running sums over ranges of (prefix, token), so that no task sorts all
    successors of a prefix.
    """
    ordered = running_before(model.transitions.select("prefix", "token", "cnt").withColumn("one", F.lit(1)), "cnt", "prefix", "token", name="before", place="one")
    heads = ordered.groupBy(F.col("prefix").alias("p")).agg(F.min("before").alias("first"), F.min("place").alias("first_place"), F.sum("cnt").alias("total"))
    rows = ordered.join(heads, F.col("prefix") == F.col("p"))
    upper, block = (F.col("before") - F.col("first") + F.col("cnt")) / F.col("total"), F.floor((F.col("place") - F.col("first_place")) / BLOCK).cast("int")
    return rows.groupBy("prefix", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(upper.alias("upper"), "token"))).alias("choices"), F.sum("cnt").alias("weight"))


def chosen(u: Column, among: str) -> Column:
    """The first of the entries, in order of their upper ends, whose interval holds ``u``; the last one if rounding leaves none."""
    first = let(u, lambda x: F.filter(among, lambda c: x < c["upper"]))  # one hash a step, not one a choice
    return F.coalesce(F.try_element_at(first, F.lit(1)), F.try_element_at(F.col(among), F.lit(-1)))


def walks(model: Model, starts: DataFrame, length: int, seed: int = 1, walk: str = "walk", start: str | None = None, small: int = SMALL) -> DataFrame:
    """(walk, tokens): at most ``length`` tokens each, until the end token or a dead end. ``start``: column with a seed text, whose tokens choose where to begin but are not emitted; unknown seeds begin at the start.

    A model of at most ``small`` blocks (they are counted) is broadcast. Of a larger one a walk first
    finds the block of its prefix, then the token in it; the blocks that hold over a HOT-th of all
    steps, or of all first steps, are broadcast, so fewer than 2 * HOT of them, and walks that stand
    before these are dealt evenly in the join with the others. Walks are written every STRIDE steps,
    and end when none goes on.
    """
    table = staged(intervals(model), "choices")
    begin = seed_prefix(F.lit(None).cast("string"), model.order)
    text = F.col(start) if start else F.lit(None).cast("string")
    now = starts.select(F.col(walk).alias("walk"), seed_prefix(text, model.order).alias("prefix"), F.array().cast("array<string>").alias("tokens"))
    if start:
        known = table.where("block = 0").select("prefix", F.lit(True).alias("known"))
        now = now.join(known, "prefix", "left").select("walk", F.when(F.col("known"), F.col("prefix")).otherwise(begin).alias("prefix"), "tokens")
    if table.count() <= small:
        found = lambda rows, u: by_broadcast(rows, u, table)
    else:
        found = by_blocks(table, start_prefix(model.order))
    written = None
    for step in range(max(0, length)):
        moved = found(now, uniform(seed, F.col("walk"), step))
        going = F.col("token").isNotNull() & (F.col("token") != END)
        now = moved.select("walk", F.when(going, next_prefix(F.col("prefix"), F.col("token"), model.order)).alias("prefix"), F.when(going, F.array_append("tokens", F.col("token"))).otherwise(F.col("tokens")).alias("tokens"))
        if (step + 1) % STRIDE == 0 and step + 1 < length:
            now = staged(now, f"walks{step}")
            discard(written)
            written = now
            if now.where("prefix IS NOT NULL").isEmpty():
                break
    return now.select("walk", "tokens")


def by_broadcast(rows: DataFrame, u: Column, table: DataFrame) -> DataFrame:
    """Append the next token; a prefix has one row for each block, of which the one that holds ``u`` matches."""
    ends = table.withColumn("upper", F.element_at("choices", -1)["upper"]).withColumn("lower", F.coalesce(F.lag("upper").over(Window.partitionBy("prefix").orderBy("block")), F.lit(-1.0)))
    ends = ends.select(F.col("prefix").alias("at"), "choices", "lower", F.when(F.lead("block").over(Window.partitionBy("prefix").orderBy("block")).isNull(), 2.0).otherwise(F.col("upper")).alias("upper"))
    met = rows.withColumn("u", u).join(F.broadcast(ends), (F.col("prefix") == F.col("at")) & (F.col("u") >= F.col("lower")) & (F.col("u") < F.col("upper")), "left")  # ``small`` blocks at most
    return met.withColumn("token", chosen(F.col("u"), "choices")["token"]).select(*rows.columns, "token")


def by_blocks(table: DataFrame, begin: str) -> Callable[[DataFrame, Column], DataFrame]:
    """The same for models of any size."""
    whole = table.agg(F.sum("weight").alias("whole"), F.sum(F.when(F.col("prefix") == begin, F.col("weight"))).alias("begins"))
    hot = (F.col("weight") * HOT > F.col("whole")) | ((F.col("prefix") == begin) & (F.col("weight") * HOT > F.col("begins")))
    marked = staged(table.join(F.broadcast(whole)).withColumn("hot", F.coalesce(hot, F.lit(False))).drop("whole", "begins"), "blocks")  # whole: one row
    listed = marked.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct(F.element_at("choices", -1)["upper"].alias("upper"), "block"))).alias("blocks"), F.bool_or("hot").alias("hot"))
    listed = staged(listed, "prefixes")

    def found(rows: DataFrame, u: Column) -> DataFrame:
        placed = spread_join(rows, listed, ["prefix"])
        at = placed.withColumn("block", chosen(u, "blocks")["block"]).drop("blocks")
        met = spread_join(at, marked.drop("weight"), ["prefix", "block"])
        return met.withColumn("token", chosen(u, "choices")["token"]).select(*rows.columns, "token")

    return found


def spread_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``, which are single in ``right``. Rows of ``right`` marked ``hot`` are broadcast (the caller bounds their number); rows of ``left`` that meet one are dealt by a hash of themselves."""
    values = [c for c in right.columns if c not in (*keys, "hot")]
    few = right.where("hot").select(*[F.col(k).alias(f"__h{k}") for k in keys], *[F.col(v).alias(f"__f{v}") for v in values])
    rest = right.where("NOT hot").select(*[F.col(k).alias(f"__r{k}") for k in keys], F.coalesce(F.col("hot").cast("int"), F.lit(0)).alias("__z"), *values)
    met = left.join(F.broadcast(few), reduce(and_, [F.col(k) == F.col(f"__h{k}") for k in keys]), "left")
    is_hot = F.col(f"__h{keys[0]}").isNotNull()
    dealt = met.withColumn("__salt", F.when(is_hot, 1 + F.pmod(F.xxhash64(*left.columns), F.lit(4096)).cast("int")).otherwise(0))
    out = dealt.join(rest, reduce(and_, [F.col(k) == F.col(f"__r{k}") for k in keys]) & (F.col("__salt") == F.col("__z")), "left")
    return out.select(*left.columns, *[F.coalesce(f"__f{v}", v).alias(v) for v in values])


def as_text(walked: DataFrame) -> DataFrame:
    return walked.select("walk", F.array_join("tokens", " ").alias("text"))


def as_json(walked: DataFrame) -> DataFrame:
    return walked.select("walk", F.to_json("tokens").alias("text"))
