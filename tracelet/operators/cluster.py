"""Behavioural clusters of distinct sequences, their profiles, and shifts between two sets.

``round_robin`` deals distinct sequences in turn, in ascending order; ``frequency_band`` goes by how
often they occur; ``kmeans_ml`` clusters by length and frequency. Ranking distinct sequences needs one
order over all of them: positions come from a range partitioning (a count of each partition, then an
offset), not from a window over everything in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.functions.staging import staged
from tracelet.functions.text import percentage_label


#: What a profile says, in our own words.
DESCRIPTIONS = {
    "power_users": "Many sessions that end where they should",
    "quick_browsers": "Sessions of one or two steps",
    "loyal": "The same paths, taken often",
    "general": "Nothing stands out",
}


def positions(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Append the row number (from 0) in a total order, without gathering rows in one task."""
    parts = df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    # ids of a partition count up from the partition's number shifted by 33 bits
    within = F.col("__m").bitwiseAND((1 << 33) - 1)
    rows = staged(parts.withColumn("__w", within), "ranked")
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__o", before)  # one row for each partition
    return rows.join(F.broadcast(offsets.select("__p", "__o")), "__p").withColumn(name, F.col("__o") + F.col("__w")).drop("__p", "__m", "__w", "__o")


def round_robin(freq: DataFrame, clusters: int = 3) -> DataFrame:
    k = max(1, clusters)
    return positions(freq, "sequence").withColumn("cluster_id", (F.col("position") % k + 1).cast("int")).drop("position")


def frequency_band(freq: DataFrame) -> DataFrame:
    return freq.withColumn("cluster_id", F.when(F.col("n") >= 10, 1).when(F.col("n") <= 3, 3).otherwise(2))


def kmeans_ml(freq: DataFrame, clusters: int = 3, seed: int = 1) -> DataFrame:
    """K-means over standardised length and log frequency."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = freq.withColumns({"__l": F.size(F.split("sequence", " ")).cast("double"), "__f": F.log1p("n")})
    rows = VectorAssembler(inputCols=["__l", "__f"], outputCol="__v").transform(rows)
    rows = StandardScaler(inputCol="__v", outputCol="__s").fit(rows).transform(rows)
    made = KMeans(k=clusters, seed=seed, featuresCol="__s", predictionCol="__c").fit(rows).transform(rows)
    return made.select(*freq.columns, (F.col("__c") + 1).alias("cluster_id"))


def assign(freq: DataFrame, algorithm: str = "kmeans", clusters: int = 3) -> DataFrame:
    """``dbscan`` is the frequency band, ``kmeans_ml`` real K-means; any other name deals in turn."""
    if algorithm in ("dbscan", "frequency_band"):
        return frequency_band(freq)
    return kmeans_ml(freq, clusters) if algorithm == "kmeans_ml" else round_robin(freq, clusters)


def profiles(assigned: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """One row for each cluster that has members. ``total``: the table whose rows are the whole of the percentages (by default the assigned one)."""
    whole = (assigned if total is None else total).agg(F.count(F.lit(1)).alias("whole"))
    size = F.size(F.split("sequence", " "))
    rows = assigned.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.round(F.sum(size) / F.count(F.lit(1)), 2).alias("avg_length"),
        F.min_by("sequence", F.struct((-F.col("n")).alias("n"), "sequence")).alias("favorite_path"),
        F.sum("n").alias("frequency"),
    )
    conversion = F.least(F.lit(1.0), F.round(F.col("frequency") / (F.col("size") * 10), 2))
    rows = rows.withColumn("conversion_rate", conversion).join(F.broadcast(whole))  # one row
    profile = F.when(F.col("conversion_rate") >= 0.6, "power_users").when(F.col("avg_length") < 3, "quick_browsers").when(F.col("frequency") >= 20, "loyal").otherwise("general")
    named = rows.withColumn("profile", profile)
    said = F.coalesce(*[F.when(F.col("profile") == name, text) for name, text in DESCRIPTIONS.items()])
    return named.select("cluster_id", "profile", said.alias("description"), "size", percentage_label(F.col("size"), F.col("whole")).alias("percentage"), "avg_length", "favorite_path", "conversion_rate", "frequency")


def shift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: whether the number of clusters or any profile name at its position differs."""
    place = Window.orderBy("cluster_id")  # as many rows as clusters
    a = baseline.select(F.row_number().over(place).alias("i"), F.col("profile").alias("a"))
    b = current.select(F.row_number().over(place).alias("i"), F.col("profile").alias("b"))
    both = a.join(b, "i", "full")
    return both.agg(F.count("a").alias("baseline_clusters"), F.count("b").alias("current_clusters"), F.coalesce(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))), F.lit(False)).alias("shifted"))



def running_before(df: DataFrame, value: str, *order: Column | str, name: str = "before", **more: str) -> DataFrame:
    """Append the sum of ``value`` over all rows before each one in a total order, and likewise a column for each of ``more`` (name=value); like ``positions``, without gathering rows in one task."""
    sums = {name: value, **more}
    parts = staged(df.orderBy(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    sizes = parts.groupBy("__p").agg(*[F.sum(v).alias(f"__n{i}") for i, v in enumerate(sums.values())])
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", *[F.coalesce(F.sum(f"__n{i}").over(earlier), F.lit(0)).alias(f"__o{i}") for i in range(len(sums))])  # one row for each partition
    here = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = parts.join(F.broadcast(offsets), "__p")
    return met.withColumns({n: F.col(f"__o{i}") + F.coalesce(F.sum(v).over(here), F.lit(0)) for i, (n, v) in enumerate(sums.items())}).drop("__p", *[f"__o{i}" for i in range(len(sums))])


def quantiles(df: DataFrame, value: str, **shares: float) -> DataFrame:
    """One row: exact percentiles (name=percent) of a numeric column, interpolated between the closest ranks, 0 of nothing.

    Distinct values are counted and put in order over ranges, and of each percentile only the two
    values beside its place are picked; no task sees all values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    placed = running_before(counted, "__c", "__v", name="__b")
    whole = placed.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("__all"))
    at = {n: F.col("__all").cast("double").__sub__(1) * (min(100.0, max(0.0, p)) / 100) for n, p in shares.items()}
    pick = lambda place: F.max(F.when(F.col("__b") <= place, F.col("__v")))  # noqa: E731  values grow with their places
    ends = placed.join(F.broadcast(whole)).groupBy("__all").agg(*[pick(rounded(at[n])).alias(f"{n}_{side}") for n in shares for side, rounded in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda n: F.when(F.col(f"{n}_lo") == F.col(f"{n}_hi"), F.col(f"{n}_lo")).otherwise((F.ceil(at[n]) - at[n]) * F.col(f"{n}_lo") + (at[n] - F.floor(at[n])) * F.col(f"{n}_hi"))
    made = ends.select(*[between(n).alias(n) for n in shares])
    return made.agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in shares])
