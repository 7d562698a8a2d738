"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is not set, one process alone takes a folder in its warehouse; on a cluster
    there is no fallback, as a folder of the driver's machine would be lost to the executors.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # one machine and one process, as in tests
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/spanforge-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage like ``checkpoint()``, stays readable when executors are
    lost, and keeps the columnar layout, so later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(column: str, k: int) -> Column:
    """crc32 of the value's text, modulo ``k`` (null values fall in fold -1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % k, F.lit(-1))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew, if it has fewer partitions than the session can run at once."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def at_random(key: str, limit: int, df: DataFrame) -> DataFrame:
    """At most ``limit`` rows of ``df`` in the order of a hash of ``key``.

    Deterministic; becomes TakeOrderedAndProject, so every task keeps ``limit``
    rows at most.
    """
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with position: the place (from 0) of each row in ``order`` over the whole table.

    The rows are dealt by ranges, sorted within them and written; a row's place is then the
    number of rows in the files before its own and its number in its file. No task orders
    all rows, and one row a file is all that is summed in one task. ``df`` has no columns
    that begin with ``_``.
    """
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order), name)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    part = F.coalesce(F.regexp_extract("_file", r"(?:^|/)part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(0))
    sizes = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n")).withColumn("_part", part)
    before = Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row a written file, and files are as many as shuffle partitions
    return rows.join(F.broadcast(starts), "_file").select(*df.columns, (F.col("_start") + F.col("_row")).alias("position"))
