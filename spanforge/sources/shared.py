"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is not set, one process alone takes a folder in its warehouse; on a cluster
    there is no fallback, as a folder of the driver's machine would be lost to the executors.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/spanforge-checkpoints"
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read again; by the values of ``by`` in folders of their own.

    What several branches of a plan read is then worked out once; the table survives lost
    executors, and later reads prune columns.
    """
    path = f"{shared_dir(df.sparkSession)}/spanforge/{name}-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
