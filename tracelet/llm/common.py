"""Shared plumbing of the corpus operators: staged tables, Arrow maps, labelled samples, skew-safe lookups."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.functions.staging import discard, reading, staged  # noqa: F401  handed on to the operators

#: Bytes of text that one call of a batch function sees at most, unless a single text is larger.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch that a worker gets, about, unless the session sets BATCH itself. Executors hold a batch several times over while it is sent.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: A class holding over 1/HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE hot classes.
HOT_SHARE = 4096
#: Hashes of ids that samples are drawn by lie below this.
SAMPLE_RANGE = 1 << 31


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of ``df`` but for those an operator is about to write (names compare without case)."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of a batch with about SLICE_BYTES of text each."""
    if batch.num_rows == 0:
        return
    size = max(1, batch.column(text).get_total_buffer_size() // max(1, batch.num_rows))
    step = max(1, min(batch.num_rows, SLICE_BYTES // size))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


_tables: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """Tables of one operator, which a worker keeps from task to task until a task of another operator begins in it."""
    return _tables.setdefault(owner, {})


def forget(but: str | None) -> None:
    """Drop the tables of all operators but one, and hand the freed memory back: workers outlive the stage they were filled in."""
    full = [t for owner, t in _tables.items() if owner != but and t]
    if not full:
        return
    for t in full:
        t.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType, owner: str | None = None) -> DataFrame:
    """``df.mapInArrow`` by batches of bounded size, in workers that hold no tables but those of ``owner``."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def map_text(
    df: DataFrame,
    text_col: str,
    out: Sequence[tuple[str, T.DataType, pa.DataType]],
    fn: Callable[[list[bytes | None]], Sequence],
    keep: Sequence[str] | None = None,
    also: Sequence[str] = (),
    owner: str | None = None,
) -> DataFrame:
    """Append the columns ``out`` that ``fn`` computes from a list of texts (UTF-8 bytes or None), and lists of the columns ``also``.

    Columns of ``df`` (or those of ``keep``) pass through as Arrow; one that has the name of an
    output is replaced. No shuffle. ``owner``: whose ``remembered`` tables ``fn`` uses.
    """
    names = [n for n, _, _ in out]
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    fields = [df.schema[c] for c in stay]
    schema = T.StructType(fields + [T.StructField(n, k) for n, k, _ in out])
    arrow = [k for _, _, k in out]
    text = "__text"
    source = df.select(*[quoted(c).alias(f"__c{i}") for i, c in enumerate(stay)], quoted(text_col).cast("string").alias(text), *[quoted(c).alias(f"__a{i}") for i, c in enumerate(also)])
    at = len(stay)
    inner = T.StructType([T.StructField(f"__c{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField(f"__o{i}", k) for i, (_, k, _) in enumerate(out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, at):
                made = fn(as_bytes(part.column(at)), *[part.column(at + 1 + i).to_pylist() for i in range(len(also))])
                columns = [part.column(i) for i in range(at)]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=inner.names)

    done = map_arrow(source, run, inner, owner)
    return done.select(*[F.col(f.name).alias(n) for f, n in zip(inner.fields, schema.names, strict=True)])


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus`` (null for a null key)."""
    return F.crc32(quoted(key).cast("string")) % modulus


def held(key: str, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(key, modulus) == value, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    usable: Column,
    per_class: int,
    max_chars: int,
    max_classes: int = 64,
    most_rows: int | None = None,
) -> list[tuple[str, str]]:
    """(text, label) of at most ``per_class`` rows of each label, the same ones however data are dealt.

    Rows are ranked by a hash of their id among the usable ids. A label's count gives the hash under
    which about twice as many rows lie as are wanted; only those ids come to the driver, and only the
    chosen texts are read. An id with several texts gives its smallest one, an id with several labels
    that text under each. With ``most_rows``, so many labels that ``per_class`` of each would be more
    rows share these evenly. So nothing is ranked in one task, however frequent a label is. Texts over
    ``max_chars`` and null texts, ids or labels take no part. At most ``max_classes`` labels are allowed.
    """
    rows = (
        labels.where(usable & quoted(label_col).isNotNull() & quoted(id_col).isNotNull())
        .select(quoted(id_col).alias("__id"), quoted(label_col).cast("string").alias("__y"))
        .withColumn("__h", F.pmod(F.xxhash64("__id"), F.lit(SAMPLE_RANGE)))
    )
    # a sketch of hashes tells about how many identifiers a label has, however often each is repeated and however rows are dealt
    counts = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.approx_count_distinct("__h", 0.02).alias("n")).limit(max_classes + 1).collect()}
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} labels in {label_col}")
    if not counts:
        return []
    if most_rows is not None:
        per_class = min(per_class, max(1, most_rows // len(counts)))
    want = 2 * per_class + min(100, per_class + 20)
    spark = docs.sparkSession
    bounds = spark.createDataFrame([(name, SAMPLE_RANGE if n <= want else SAMPLE_RANGE * want // n) for name, n in sorted(counts.items())], "__l string, __m long")
    under = rows.join(F.broadcast(bounds), (F.col("__y") == F.col("__l")) & (F.col("__h") < F.col("__m"))).select("__y", "__h", "__id")  # bounds: a row for each label
    near = under.distinct().orderBy("__h", "__id", "__y").limit(3 * want * len(counts)).collect()  # far more than there are; the smallest hashes in any case
    near.sort(key=lambda r: (r["__y"], r["__h"], r["__id"]))
    chosen = [r for _, own in groupby(near, key=lambda r: r["__y"]) for r in islice(own, per_class)]
    if not chosen:
        return []
    small = spark.createDataFrame([(r["__id"], r["__y"]) for r in chosen], T.StructType([T.StructField("__id", rows.schema["__id"].dataType), T.StructField("__y", T.StringType())]))
    texts = (
        docs.select(quoted(id_col).alias("__id"), quoted(text_col).cast("string").alias("__t"))
        .where(F.col("__t").isNotNull() & (F.length("__t") <= max_chars))
        .join(F.broadcast(small), "__id")
        .groupBy("__id", "__y")
        .agg(F.min("__t").alias("__t"))
        .select(F.xxhash64("__id").alias("__h"), "__id", "__t", "__y")
        .collect()
    )
    return [(r["__t"], r["__y"]) for r in sorted(texts, key=lambda r: (r["__h"], r["__id"], r["__y"]))]


def plain_names(df: DataFrame, kept: Sequence[str], *more: Column) -> DataFrame:
    """The columns ``kept`` of ``df`` as c0, c1, .. and then ``more``, so that whatever they are called clashes with nothing an operator adds."""
    return df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], *more)


def own_names(df: DataFrame, kept: Sequence[str], *more: Column) -> DataFrame:
    """Undo ``plain_names``."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *more)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which have no hash, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(quoted(f.name))) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else quoted(f.name) for f in df.schema])


def one_of_each(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Append whether a row is the one picked of those alike in ``by``: the one with the smallest hash of all its columns.

    So the pick is the same however rows are dealt and tasks are repeated; rows that are equal in all
    columns are interchangeable. One is picked in each partition first, then one of these, so rows
    alike never gather in one task.
    """
    dealt = df.withColumns({"__h": row_hash(df), "__p": F.spark_partition_id()})
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__h")))
    first = F.col("__r") == 1
    # the first rows of all partitions meet; the others stay apart, and the rows are computed once
    apart = ranked.withColumn("__s", F.when(first, -1).otherwise(F.col("__p")))
    met = Window.partitionBy(*by, "__s").orderBy("__h", "__p")
    return apart.withColumn(out, first & (F.row_number().over(met) == 1)).drop("__h", "__p", "__r", "__s")


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join on ``key``, where ``right`` has one row a key and ``weight`` counts the left rows of it.

    Keys with more than 1/HOT_SHARE of all left rows, and more than 64 (fewer than HOT_SHARE of them,
    so a proven bound) are broadcast. Their rows then pass the shuffled join dealt by a hash of themselves, and
    meet nothing there; every other key has few rows. So no task is hot, and ``left`` is computed
    once. ``key`` must not be null in either side. ``total``: rows of ``left``. Columns must be named
    as ``plain_names`` does it, or be the caller's own.
    """
    least = max(64, total // HOT_SHARE)
    names = [c for c in right.columns if c != key]
    # __z is always 0, but must not be seen to be: a constant would leave the join's key, and the salt with it
    hot = right.where(F.col(weight) > least).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__h_{c}") for c in names])
    rest = right.where(F.col(weight) <= least).select(F.col(key).alias("__c"), F.least(weight, F.lit(0)).cast("int").alias("__z"), *[F.col(c).alias(f"__r_{c}") for c in names])
    is_hot = F.col("__k").isNotNull()
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("__k"), "left")
    dealt = marked.withColumn("__salt", F.when(is_hot, 1 + F.pmod(row_hash(left), F.lit(HOT_SHARE)).cast("int")).otherwise(0))
    met = dealt.join(rest, (F.col(key) == F.col("__c")) & (F.col("__salt") == F.col("__z")), "left")
    return met.select(*[quoted(c) for c in left.columns], *[F.coalesce(f"__h_{c}", f"__r_{c}").alias(c) for c in names])
