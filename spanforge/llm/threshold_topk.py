"""Exact top-k by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors become whole numbers floor(scale * x). Entries are dealt by a hash of vec_id to
bins of about ``ENTRY_LIMIT`` rows. A bin sorts its rows by every dimension. For a query,
all its dimensions' lists are read in step, from the end that the sign of the query's
component favours; every new row is scored at once, and no unread row can score more than
the threshold: the sum over the dimensions of component times value at the list's
position. Reading stops when the threshold is below the k-th score so far; at a tie it
goes on, as an unread row with a smaller vec_id could win.

Each step reads four times as deep as the last, so the rounds stay logarithmic; once
every row of the bin has been read, no bound is needed.

Defined cases: null vectors, vectors with null or non-finite components, null ids and
vectors of another than the most frequent dimension take no part; zero vectors do. Rows
with equal vec_id and vector count once, and rows of one vec_id that score the same for a
query are one neighbour of it. With fewer than k candidates all are returned;
an empty table gives an empty result. Whole numbers are summed as 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.vectors import ENTRY_LIMIT, QUERY_LIMIT, best_k, clean, is_query, matrix, merged

FIRST_DEPTH = 64


class SortedLists:
    """The rows of a bin, sorted by every dimension (ascending)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids = ids
        self.repeats = len(np.unique(ids)) < len(ids)
        big = float(np.abs(rows).max()) if rows.size else 0.0
        most = big * big * max(rows.shape[1], 1)
        # the narrowest type in which every partial sum is exact
        self.rows = rows.astype(np.float32 if most < 2**23 else np.float64) if most < 2**52 else rows
        self.order = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32))
        self.value = np.take_along_axis(rows, self.order.T.astype(np.int64), 0).T

    def _single(self, have: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """One of the rows of each vec_id and score."""
        if not self.repeats:
            return have
        have = have[np.lexsort((scores[have], self.ids[have]))]
        same = (self.ids[have[1:]] == self.ids[have[:-1]]) & (scores[have[1:]] == scores[have[:-1]])
        return have[np.append(True, ~same)] if len(have) else have

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k best rows but the query's own, and how deep was read."""
        n = len(self.ids)
        down, up = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        q = query.astype(self.rows.dtype)
        scores = np.empty(n, np.int64)
        fresh = np.ones(n, bool)  # not read yet
        other = self.ids != own
        depth, last = 0, 0
        while True:
            depth = min(n, max(FIRST_DEPTH, n // 128, depth * 4))
            if len(down) + len(up) == 0:
                depth = n
            was = fresh.copy()
            fresh[self.order[down, n - depth : n - last].ravel()] = False
            fresh[self.order[up, last:depth].ravel()] = False
            if depth == n:
                fresh[:] = False
            new = np.flatnonzero(was & ~fresh)
            scores[new] = self.rows[new] @ q
            last = depth
            have = self._single(np.flatnonzero(other & ~fresh), scores)
            if not fresh.any():
                break
            if len(have) >= k:
                kth = np.partition(scores[have], len(have) - k)[len(have) - k]
                # the next unread value of each list bounds all unread rows
                bound = (self.value[down, n - depth - 1] * query[down]).sum() + (self.value[up, depth] * query[up]).sum()
                if bound < kth:
                    break
        if len(have) > k:
            kth = np.partition(scores[have], len(have) - k)[len(have) - k]
            have = have[scores[have] >= kth]
        have = have[best_k(self.ids[have], scores[have], k)]
        return self.ids[have], scores[have], depth


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, entry_limit: int = ENTRY_LIMIT, query_limit: int = QUERY_LIMIT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best for every query.

    Queries are the rows whose vec_id is divisible by ``every``.
    """
    rows, dim, n, norm = clean(vectors, zero=True)
    bins, parts = max(1, math.ceil(n / entry_limit)), max(1, math.ceil(n / every / query_limit))
    whole = rows.select("vec_id", F.expr(f"transform(vec, x -> cast(floor({scale}D * x) as long))").alias("vec"))
    whole = whole.dropDuplicates(["vec_id", "vec"])  # else the copies of a row fill one bin
    entries = whole.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(bins)).alias("bin"), F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"))
    queries = whole.filter(is_query(every)).select("vec_id", "vec", F.explode(F.expr(f"sequence(0L, {bins - 1}L)")).alias("bin"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            bin_ = SortedLists(left.column("vec_id").to_numpy(), matrix(left.column("vec")))
            for own, q in zip(right.column("vec_id").to_numpy().tolist(), matrix(right.column("vec")), strict=True):
                ids, scores, _ = bin_.top(q, own, k)
                out.append((np.full(len(ids), own, np.int64), ids, scores))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    found = entries.groupBy("bin", "part").cogroup(queries.groupBy("bin", "part")).applyInArrow(cell, "query_id long, vec_id long, score long")
    return merged(found, k)
