"""Approximate nearest neighbours by balanced posting lists.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the
greatest norm, which is zero for queries. Balanced k-means over a bounded sample gives
the centroids; each vector goes to the posting list of its nearest centroid, and vectors
near a boundary (distance within ``CLOSURE`` of the nearest) to up to ``REPLICAS`` lists.
Centroids are searched by best-first walks with a bounded beam on an in-memory neighbour
graph. A query reads the lists whose centroids lie within a ratio of its nearest
centroid's distance; the ratio is the least that reaches ``TARGET`` of the true neighbours
of queries in the sample. A list is scored for the queries that read it only, and
candidates are ranked by their exact inner product in double precision.

Lists are packed into bins of bounded size; a list that is larger (a vector may be very
common) is cut into parts by a hash of vec_id, and a query reads all parts. Only the
sample, the centroids and the sizes of the lists reach the driver; all three are bounded
by parameters.

Defined cases: vectors that are null, zero, or hold null or non-finite components, null
ids and vectors of another than the most frequent dimension take no part. Rows with
equal vec_id and vector count once. Fewer candidates than k: all that are found. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import at_random
from spanforge.llm.vectors import ENTRY_LIMIT, QUERY_LIMIT, clean, is_query, lists, matrix, merged

SAMPLE, PER_LIST = 16_000, 4
LIST_SIZE = 160
MAX_LISTS = 65_536
REPLICAS, CLOSURE = 3, 1.08
DEGREE = 24
TARGET, QUERIES = 0.94, 400
BATCH = 1_024
BLOCK_CELLS = 4_000_000  # scores held at once


def balanced_centroids(x: np.ndarray, k: int, radius: float, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k-means on a sphere, whose large clusters repel: a cluster's distances grow with its size.

    Means are put back on the sphere; else the mean of a large cluster, which lies near the
    middle, would be the nearest to everything.
    """
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.zeros(k, np.float32)
    for _ in range(rounds):
        own = np.empty(len(x), np.int64)
        for a in range(0, len(x), 4 * BATCH):
            near = x[a : a + 4 * BATCH] @ centers.T
            own[a : a + 4 * BATCH] = (near - near.std() * load).argmax(1)
        size = np.bincount(own, minlength=k)
        load += (0.3 * np.clip(size / max(len(x) / k, 1e-9) - 1, -1, 2)).astype(np.float32)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        full = size > 0
        norm = np.sqrt((sums[full] * sums[full]).sum(1, keepdims=True))
        centers[full] = sums[full] / np.maximum(norm, 1e-12) * radius
        centers[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centers


class CentroidGraph:
    """Nearest centroids by best-first search with a bounded beam on a neighbour graph, many points at a time."""

    def __init__(self, centers: np.ndarray, degree: int = DEGREE):
        self.centers = centers
        self.square = (centers * centers).sum(1)
        k = len(centers)
        self.links = np.empty((k, 0), np.int64)
        if k > 1:
            deg = min(degree, k - 1)
            near = np.empty((k, deg), np.int64)
            for a in range(0, k, BATCH):
                d = self.square - 2 * (centers[a : a + BATCH] @ centers.T)
                d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
                near[a : a + BATCH] = np.argpartition(d, deg - 1, 1)[:, :deg]
            ring = np.stack(((np.arange(k) + 1) % k, (np.arange(k) + k // 2) % k), 1)  # keeps the graph in one piece
            self.links = np.concatenate((near, ring), 1)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))
        self.visited = 0  # distances computed so far

    def _distances(self, x: np.ndarray, own: np.ndarray, node: np.ndarray) -> np.ndarray:
        self.visited += node.size
        return own[:, None] - 2 * np.matmul(self.centers[node], x[:, :, None])[:, :, 0] + self.square[node]

    def search(self, x: np.ndarray, width: int, wave: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Per point: the ``width`` nearest centroids found (fewer if there are fewer) and their distances, nearest first."""
        n, k = len(x), len(self.centers)
        width = min(width, k)
        own = (x * x).sum(1)
        beam = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        d = self._distances(x, own, beam)
        open_ = np.ones(beam.shape, bool)
        room = min(k, max(width, len(self.entries)))
        beam = np.concatenate((beam, np.full((n, room - beam.shape[1]), -1)), 1)
        d = np.concatenate((d, np.full((n, room - d.shape[1]), np.inf)), 1)
        open_ = np.concatenate((open_, np.zeros((n, room - open_.shape[1]), bool)), 1)
        going = np.arange(n)
        while k > 1:
            going = going[open_[going].any(1)]
            if not len(going):
                break
            step = min(wave, room)
            rest = np.where(open_[going], d[going], np.inf)
            pick = np.argpartition(rest, step - 1, 1)[:, :step] if step < room else np.broadcast_to(np.arange(room), rest.shape)
            useful = np.isfinite(np.take_along_axis(rest, pick, 1))
            node = np.where(useful, np.take_along_axis(beam[going], pick, 1), -1)
            marks = open_[going]
            np.put_along_axis(marks, pick, False, 1)
            new = np.where(node[:, :, None] >= 0, self.links[node], -1).reshape(len(going), -1)
            # a node in the beam comes before its copies among the new ones
            both = np.concatenate((beam[going], new), 1)
            order = np.argsort(both, 1, kind="stable")
            both = np.take_along_axis(both, order, 1)
            twice = np.zeros(both.shape, bool)
            twice[:, 1:] = both[:, 1:] == both[:, :-1]
            twice |= both < 0
            was = order < room
            near = np.full(both.shape, np.inf)
            near[was] = np.take_along_axis(np.concatenate((d[going], np.full(new.shape, np.inf)), 1), order, 1)[was]
            near[twice] = np.inf
            fresh = ~was & ~twice
            row, col = np.nonzero(fresh)
            if len(row):
                self.visited += len(row)
                at = both[row, col]
                near[row, col] = own[going[row]] - 2 * np.einsum("ij,ij->i", x[going[row]], self.centers[at]) + self.square[at]
            flags = np.take_along_axis(np.concatenate((marks, np.ones(new.shape, bool)), 1), order, 1) & np.isfinite(near)
            keep = np.argpartition(near, room - 1, 1)[:, :room] if room < near.shape[1] else np.broadcast_to(np.arange(room), near.shape)
            beam[going], d[going], open_[going] = (np.take_along_axis(t, keep, 1) for t in (both, near, flags))
        best = np.argsort(d, 1, kind="stable")[:, :width]
        return np.take_along_axis(beam, best, 1), np.sqrt(np.maximum(np.take_along_axis(d, best, 1), 0))


def list_count(n: int) -> int:
    """Posting lists for n vectors: of about ``LIST_SIZE`` vectors, up to ``MAX_LISTS`` of them."""
    return max(1, min(MAX_LISTS, math.ceil(n / LIST_SIZE)))


class Index:
    """Centroids, their graph, the pruning ratio, and how many lists a query reads at most."""

    def __init__(self, sample: np.ndarray, norm: float, n: int, target: float = TARGET, seed: int = 0):
        self.norm = norm
        x = self.lift(sample)
        k = min(list_count(n), len(x))
        # the ratio is fitted to queries that the centroids have not seen, where the sample allows it
        apart = QUERIES if len(x) >= max(4 * QUERIES, 2 * k) else 0
        self.graph = CentroidGraph(balanced_centroids(x[apart:], k, norm, seed=seed))
        self.floor = 0.0  # a query closer to a centroid than is usual reads as if it were at the usual distance
        self.ratio, self.width = self._fit(sample, x, target, n)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.concatenate((x, rest[:, None]), 1).astype(np.float32)

    def flat(self, x: np.ndarray) -> np.ndarray:
        """Queries, stretched to the same sphere; that does not change which inner products are greater."""
        x = x * (self.norm / np.sqrt((x * x).sum(1, keepdims=True)))
        return np.concatenate((x, np.zeros((len(x), 1))), 1).astype(np.float32)

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """The posting lists of each vector."""
        out = []
        for a in range(0, len(x), BATCH):
            near, d = self.graph.search(self.lift(x[a : a + BATCH]), 4 * REPLICAS)
            ok = d[:, :REPLICAS] <= d[:, :1] * CLOSURE + 1e-12
            out += [row[m] for row, m in zip(near[:, :REPLICAS], ok, strict=True)]
        return out

    def reads(self, x: np.ndarray) -> list[np.ndarray]:
        """The posting lists that each query reads."""
        out = []
        for a in range(0, len(x), BATCH):
            near, d = self.graph.search(self.flat(x[a : a + BATCH]), self.width)
            ok = d <= np.maximum(d[:, :1], self.floor) * self.ratio + 1e-12
            out += [row[m] for row, m in zip(near, ok, strict=True)]
        return out

    def _fit(self, sample: np.ndarray, x: np.ndarray, target: float, n: int, queries: int = QUERIES, k: int = 20) -> tuple[float, int]:
        """The least ratio that reaches ``target`` of the true neighbours in the sample, and the lists that nearly all queries then read.

        Of the k nearest of n vectors a sample holds the share that it is of them, so it is
        that many that are looked for.
        """
        q = self.flat(sample[:queries])
        homes = self.homes(sample)
        wide = max(map(len, homes))
        table = np.array([np.concatenate((h, np.repeat(h[:1], wide - len(h)))) for h in homes])
        d = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * (q @ self.graph.centers.T) + self.graph.square, 0))
        least = d.min(1, keepdims=True)
        self.floor = float(np.median(least))
        share = d / np.maximum(np.maximum(least, self.floor), 1e-12)
        scores = sample[:queries] @ sample.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(max(1, round(k * len(sample) / n)), len(sample) - 1)
        if k < 1:
            return 1.0, 1
        true = np.argpartition(-scores, k - 1, 1)[:, :k]
        ratio = float(np.quantile(np.take_along_axis(share[:, None, :], table[true], 2).min(2), target))
        return ratio, int(np.quantile((share <= ratio).sum(1), 0.99)) + 1


def few_of_each(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of every set of equal rows: the others cannot be among the k nearest of anything."""
    _, same = np.unique(x, axis=0, return_inverse=True)
    order = np.argsort(same, kind="stable")
    same = same[order]
    return np.sort(order[np.arange(len(same)) - np.searchsorted(same, same) < k])


def _plan(sizes: dict[int, int], reads: dict[int, int], n_queries: int, entry_limit: int, query_limit: int) -> dict[int, tuple[int, int, int]]:
    """list -> (first bin, parts of the list, parts of the queries)."""
    plan, at, held, asked, group = {}, 0, 0, 0, []

    def close() -> None:
        nonlocal at, held, asked, group
        if group:
            cuts = max(1, math.ceil(min(asked, n_queries) / query_limit))
            plan.update({g: (at, 1, cuts) for g in group})
            at, held, asked, group = at + 1, 0, 0, []

    for key in sorted(sizes):
        n = sizes[key]
        if n > entry_limit:
            close()
            parts = math.ceil(n / entry_limit)
            plan[key] = (at, parts, max(1, math.ceil(reads.get(key, 0) / query_limit)))
            at += parts
            continue
        if held + n > entry_limit:
            close()
        group.append(key)
        held, asked = held + n, asked + reads.get(key, 0)
    close()
    return plan


def search(vectors: DataFrame, k: int = 20, every: int = 20, sample: int | None = None, entry_limit: int = ENTRY_LIMIT, query_limit: int = QUERY_LIMIT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for every query.

    Queries are the rows whose vec_id is divisible by ``every``. The index is fitted to
    at most ``sample`` vectors (by a hash of vec_id; by default 16,000, or four a list, so
    262,144 at most) and holds every vector.
    """
    spark = vectors.sparkSession
    rows, dim, n, norm = clean(vectors, zero=False)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = max(SAMPLE, PER_LIST * list_count(n)) if sample is None else sample
    drawn = matrix(at_random("vec_id", size, rows).select("vec").toArrow().column("vec"))
    index = spark.sparkContext.broadcast(Index(drawn, norm, n))
    asking = rows.filter(is_query(every))
    # what is stored as floats is shuffled as floats; scores are computed in double precision
    stored = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    width = np.float32 if stored == "float" else np.float64

    def sizes(batches: Iterator[pa.RecordBatch], homes: bool) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.value.graph.centers), np.int64)
        for b in batches:
            x = matrix(b.column("vec"))
            if len(x):
                np.add.at(total, np.concatenate(index.value.homes(x) if homes else index.value.reads(x)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["list", "n"])

    def count(df: DataFrame, homes: bool) -> dict[int, int]:
        got = df.select("vec").mapInArrow(lambda it: sizes(it, homes), "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()
        return {r["list"]: r["n"] for r in got}

    asked = count(asking, False)
    plan = spark.sparkContext.broadcast(_plan(count(rows, True), asked, math.ceil(n / every), entry_limit, query_limit))

    def deal_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, ids, salt = matrix(b.column("vec")), b.column("vec_id").to_numpy(), b.column("salt").to_numpy()
            out = []
            for i, homes in enumerate(index.value.homes(x)):
                for h in homes.tolist():
                    first, parts, cuts = plan.value[h]
                    out += [(i, h, first + int(salt[i] % parts), c) for c in range(cuts)]
            i, h, bin_, cut = (np.array(c, np.int64) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), lists(x[i].astype(width)), pa.array(h), pa.array(bin_), pa.array(cut)], names=["vec_id", "vec", "list", "bin", "part"])

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, ids, salt = matrix(b.column("vec")), b.column("vec_id").to_numpy(), b.column("salt").to_numpy()
            out: list[tuple[int, int, int, list[int]]] = []
            for i, read in enumerate(index.value.reads(x)):
                bins: dict[int, list[int]] = {}
                for h in read.tolist():
                    if h in plan.value:
                        first, parts, cuts = plan.value[h]
                        for p in range(parts):
                            bins.setdefault(first + p, [cuts]).append(h)
                out += [(i, bin_, int(salt[i] % own[0]), own[1:]) for bin_, own in bins.items()]
            if out:
                i = np.array([o[0] for o in out])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), lists(x[i].astype(width)), pa.array([o[3] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], names=["vec_id", "vec", "lists", "bin", "part"])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, entry, score
        if left.num_rows and right.num_rows:
            ids, x, of = left.column("vec_id").to_numpy(), matrix(left.column("vec")).astype(np.float64), left.column("list").to_numpy()
            order = np.lexsort((ids, of))
            ids, x, of = ids[order], x[order], of[order]
            q, own = matrix(right.column("vec")).astype(np.float64), right.column("vec_id").to_numpy()
            asked = right.column("lists").combine_chunks()
            reader, read = np.repeat(np.arange(len(q)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy()
            by = np.argsort(read, kind="stable")
            reader, read = reader[by], read[by]
            for name in np.unique(of).tolist():
                members = np.arange(*np.searchsorted(of, [name, name + 1]))
                members = members[few_of_each(x[members], k + 1)]
                who = reader[slice(*np.searchsorted(read, [name, name + 1]))]
                # a list is scored for the queries that read it, and for no others
                for a in range(0, len(who), BLOCK_CELLS // len(members) + 1):
                    some = who[a : a + BLOCK_CELLS // len(members) + 1]
                    near = q[some] @ x[members].T
                    near[ids[members] == own[some][:, None]] = -np.inf
                    if len(members) > k:
                        low = np.partition(near, len(members) - k, 1)[:, len(members) - k]
                        low = low - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(low), low, 0)))
                    else:
                        low = np.full(len(some), -np.inf)
                    i, j = np.nonzero((near >= low[:, None]) & np.isfinite(near))
                    i, j = some[i], members[j]
                    found.append((i, j, (x[j] * q[i]).sum(1)))  # equal vectors get equal scores
        cols = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if found:
            i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ids[j], -score, i))
            i, name, score = i[order], ids[j][order], score[order]
            new = np.append(True, (i[1:] != i[:-1]) | (name[1:] != name[:-1]) | (score[1:] != score[:-1]))  # replicas
            i, name, score = i[new], name[new], score[new]
            first = np.searchsorted(i, i)
            best = np.arange(len(i)) - first < k
            cols = [own[i[best]], name[best], score[best]]
        return pa.table([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    salted = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)).alias("salt")
    entries = rows.select("vec_id", "vec", salted).mapInArrow(deal_entries, f"vec_id long, vec array<{stored}>, list long, bin long, part long")
    queries = asking.select("vec_id", "vec", salted).mapInArrow(deal_queries, f"vec_id long, vec array<{stored}>, lists array<long>, bin long, part long")
    found = entries.groupBy("bin", "part").cogroup(queries.groupBy("bin", "part")).applyInArrow(cell, "query_id long, vec_id long, score double")
    return merged(found, k)
