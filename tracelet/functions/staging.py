"""Tables written to the shared folder, which cuts lineage and outlives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on local masters a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tracelet-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of ``by``, and read it again.

    What the result of an operator reads stays until the shared folder is cleaned; ``discard`` takes
    away what only a later table of the same operator was made from.
    """
    folder = f"{shared_dir(df.sparkSession)}/tracelet-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{folder}/{name}")
    made = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    made._staged_in = folder
    return made


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """Note which staged tables ``df`` reads, so that discarding it discards them."""
    df._reads = tables
    return df


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables that nothing will read again; other tables and None are left alone."""
    for t in tables:
        discard(*getattr(t, "_reads", ()))
        folder = getattr(t, "_staged_in", None)
        if folder is not None:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
