"""What the two vector searches share: clean vectors, bounded cells, merging of top lists.

Entries (all vectors) and queries meet in cells: pairs of an entry bin and a query part,
both of bounded size, so no task holds more than one of each. Every cell keeps the best
k of each of its queries, and the lists of all cells are merged by a rank that Spark
already cuts before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY_LIMIT = 16_384
QUERY_LIMIT = 2_048


def clean(vectors: DataFrame, zero: bool) -> tuple[DataFrame, int, int, float]:
    """vec_id long, vec array<double>; their dimension, number and greatest norm.

    Left out: null ids, vectors that are null, empty, hold null or non-finite components,
    are zero (unless ``zero``), or are not of the most frequent dimension (ties: the larger).
    """
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id is not null and size(vec) > 0")
    rows = rows.filter(F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"))
    if not zero:
        rows = rows.filter(F.expr("exists(vec, x -> x <> 0)"))
    norm = F.expr("sqrt(aggregate(vec, 0D, (a, x) -> a + x * x))")
    found = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not found:
        return rows.limit(0), 0, 0, 0.0
    best = found[0]
    return rows.filter(F.size("vec") == best["dim"]), best["dim"], best["n"], best["norm"]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of equal-length lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def lists(values: np.ndarray) -> pa.ListArray:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(values.ravel()))


def best_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def merged(parts: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from the lists of all cells (query_id, vec_id, score).

    A vector that several cells found has equal ranks, so it is counted once.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = parts.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return near.groupBy("query_id", "rank").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score")).select("query_id", "rank", "vec_id", "score")


def is_query(every: int) -> Column:
    return F.pmod(F.col("vec_id"), F.lit(every)) == 0
