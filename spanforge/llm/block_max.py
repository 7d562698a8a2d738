"""Ranked lexical search with block-max pruning.

The *forward index* is a table with one row a document (its terms, how often each occurs, and
the number of all), written once; a *block* is a range of ``BLOCK`` documents as they are
stored. A document's share of a query is, for each term, its weight times the *impact*
``1000000000 * tf div (1000 * tf + 8 * m)``, with m from the document's length.

A task reads a shard of blocks, takes of each block the greatest impact of every term, and
from these the *bound* of each query: no document of the block can score more. The blocks of
a query are sorted by bound, the first ones are scored from the forward index, and the search
stops where the next bound is below the k-th best score so far; later shards of the task
begin with that score. The best of all tasks are then ranked. Ties need ``bound = score``
to be looked at, so the result is exact: the same as scoring every document.

Queries are a stated set against all documents: they are handed to the tasks in batches of
at most about ``BATCH`` terms, each found, counted and searched for itself, so what is
broadcast is bounded whatever the number of queries. A task holds ``SHARD`` postings of
query terms. What is shuffled is k rows a query and task.

A term is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII, with
A-Z in lower case. Whole numbers are 64-bit.

Defined cases: documents with null, empty or termless texts are not indexed and not counted;
rows of one doc_id are documents of their own; a null doc_id comes after all others of equal
score. Rows of one item_id are one query with the terms of all its rows (null is an id as
well); queries without a term that occurs get no rows, nor do documents with score 0. Empty
tables give an empty result. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import ascii_lower, materialize

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BLOCK, SHARD, BATCH = 16, 2_000_000, 1_000_000
SCALE = 1_000_000_000


def terms_of(raw: bytes) -> list[bytes]:
    """Terms of a UTF-8 text; the lower case of bytes is that of ASCII alone."""
    return _TERM.findall(raw.lower())


def build(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The forward index, written: block, doc_id, n (terms with repeats), terms, tfs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    slots = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < slots:
        rows = rows.repartitionByRange(slots, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            rows, sizes, terms, tfs, ends = [], [], [], [], [0]
            for i, raw in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                found = terms_of(raw)
                if found:
                    n = Counter(found)
                    rows.append(i)
                    sizes.append(len(found))
                    terms += n.keys()
                    tfs += n.values()
                    ends.append(len(terms))
            place = (seen + np.arange(len(rows))) // block
            seen += len(rows)
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()))
            often = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), words, often], names=["block", "doc_id", "n", "terms", "tfs"])

    return materialize(rows.mapInArrow(run, "block long, doc_id long, n long, terms array<string>, tfs array<int>"), "forward-index")


class Queries:
    """A batch of queries: the terms they hold, and of each query the numbers of its terms and their multiplicities."""

    def __init__(self, terms: list[str], of: list[tuple[np.ndarray, np.ndarray]]):
        self.terms, self.of = terms, of
        self.weight = np.zeros(len(terms), np.int64)

    def weigh(self, df: np.ndarray, docs: int) -> Queries:
        held = df > 0
        self.weight[held] = np.floor(1000 * np.log((2 * docs + 2) / (2 * df[held] + 1))).astype(np.int64)
        return self


def places(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of every posting of ``batch`` the number of its term (-1: none of ``terms``) and its row."""
    column = batch.column("terms")
    at = pc.fill_null(pc.index_in(column.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    return at, np.repeat(np.arange(batch.num_rows), pc.list_value_length(column).to_numpy(zero_copy_only=False))


def frequencies(index: DataFrame, terms: list[str]) -> np.ndarray:
    """The number of documents that hold each of ``terms``."""
    held = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value, pa.string())
        n = np.zeros(len(held.value), np.int64)
        for b in batches:
            at, _ = places(b, known)
            n += np.bincount(at[at >= 0], minlength=len(n))
        some = n.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


class Best:
    """The k best (score, doc_id) of a query so far; a null doc_id comes last among equals."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.nulls = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a document must score to come in: more than nothing, or no less than the k-th."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        take = scores >= self.least
        if take.any():
            s, i, n = (np.concatenate(x) for x in ((self.scores, scores[take]), (self.ids, ids[take]), (self.nulls, nulls[take])))
            order = np.lexsort((i, n, -s))[: self.k]
            self.scores, self.ids, self.nulls = s[order], i[order], n[order]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    size = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


class Shard:
    """Blocks of documents in arrays: postings by document, documents by block, and the greatest impacts by term."""

    def __init__(self, block: np.ndarray, ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, vocabulary: int):
        self.ids, self.nulls, self.term, self.impact = ids, nulls, term, impact
        self.doc_start = np.concatenate(([0], np.cumsum(sizes)))
        opens = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
        self.block_start = np.concatenate((opens.nonzero()[0], [len(ids)]))
        self.blocks = len(self.block_start) - 1
        self.scored = 0
        of = np.repeat(np.cumsum(opens) - 1, sizes)
        key = term.astype(np.int64) * max(self.blocks, 1) + of
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.concatenate(([0], (key[1:] != key[:-1]).nonzero()[0] + 1)) if len(key) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(impact[order], first) if len(key) else impact
        self.most_block = key[first] % max(self.blocks, 1)
        self.term_start = np.searchsorted(key[first] // max(self.blocks, 1), np.arange(vocabulary + 1))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What no document of a block can exceed, for a query."""
        out = np.zeros(self.blocks, np.int64)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            a, b = self.term_start[t], self.term_start[t + 1]
            out[self.most_block[a:b]] += w * self.most[a:b]
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, dense: np.ndarray) -> None:
        """Puts what scores enough into ``best``; ``dense`` is a row of zeros, one a term, and is left so."""
        bounds = self.bounds(terms, weights)
        order = np.argsort(-bounds, kind="stable")
        dense[terms] = weights
        at, step = 0, 4
        while at < len(order) and bounds[order[at]] >= best.least:
            some = order[at : at + step]
            some = np.sort(some[bounds[some] >= best.least])
            docs = ranges(self.block_start[some], self.block_start[some + 1])
            sizes = self.doc_start[docs + 1] - self.doc_start[docs]
            posts = ranges(self.doc_start[docs], self.doc_start[docs + 1])
            value = dense[self.term[posts]] * self.impact[posts]
            # every document of a shard holds a term, so no sum is empty
            scores = np.add.reduceat(value, np.concatenate(([0], np.cumsum(sizes)[:-1])))
            best.add(scores, self.ids[docs], self.nulls[docs])
            self.scored += len(some)
            at, step = at + step, step * 2
        dense[terms] = 0


def best_of_tasks(index: DataFrame, queries: Queries, docs: int, length: int, k: int) -> DataFrame:
    """query (number in the batch), doc_id, score, of the k best of every task; blocks and scored (block visits) as well."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        known = pa.array(q.terms, pa.string())
        best = [Best(k) for _ in q.of]
        dense = np.zeros(len(q.terms), np.int64)
        parts: list[tuple] = []
        seen, visits = 0, [0, 0]

        def search() -> None:
            shard = Shard(*(np.concatenate([p[i] for p in parts]) for i in range(6)), len(q.terms))
            for b, (terms, times) in zip(best, q.of, strict=True):
                shard.search(terms, times * q.weight[terms], b, dense)
            visits[0] += shard.blocks * len(best)
            visits[1] += shard.scored

        for b in batches:
            at, row = places(b, known)
            take = at >= 0
            at, row = at[take], row[take]
            tf = b.column("tfs").flatten().to_numpy(zero_copy_only=False)[take].astype(np.int64)
            m = 25 + 75 * b.column("n").to_numpy(zero_copy_only=False).astype(np.int64) * docs // length
            sizes = np.bincount(row, minlength=b.num_rows)
            some = sizes.nonzero()[0]
            ids = b.column("doc_id")
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            parts.append((b.column("block").to_numpy(zero_copy_only=False)[some], pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[some], nulls[some], sizes[some], at, SCALE * tf // (1000 * tf + 8 * m[row])))
            seen += len(at)
            if seen >= SHARD:
                search()
                parts, seen = [], 0
        if parts:
            search()
        query = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        ids = pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.nulls for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(query), ids, pa.array(np.concatenate([b.scores for b in best])), pa.array(np.full(len(query), visits[0])), pa.array(np.full(len(query), visits[1]))], names=["query", "doc_id", "score", "blocks", "scored"])

    return index.mapInArrow(run, "query long, doc_id long, score long, blocks long, scored long")


def search(index: DataFrame, items: DataFrame, k: int = 10, batch: int = BATCH) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of ``index`` for each item (item_id, text)."""
    spark = index.sparkSession
    totals = index.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    words = F.explode(F.regexp_extract_all(ascii_lower(F.col("text").cast("string")), F.lit(TERMS), F.lit(0)))
    asked = materialize(items.select(F.col("item_id").alias("item_id"), words.alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n")), "queries")
    out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id long, score long")
    n = -(-asked.count() // batch) if totals["docs"] else 0
    for part in range(n):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part)
        rows = mine.groupBy("item_id").agg(F.collect_list(F.struct("term", "n")).alias("terms")).collect()  # bounded by the batch
        known = sorted({t["term"] for r in rows for t in r["terms"]})
        at = {t: i for i, t in enumerate(known)}
        pairs = [(np.array([at[t["term"]] for t in r["terms"]], np.int64), np.array([t["n"] for t in r["terms"]], np.int64)) for r in rows]
        if not rows:
            continue
        queries = Queries(known, pairs).weigh(frequencies(index, known), totals["docs"])
        found = best_of_tasks(index, queries, totals["docs"], totals["length"], k).select("query", "doc_id", "score")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query long, item_id {items.schema['item_id'].dataType.simpleString()}")
        out = out.unionByName(found.join(F.broadcast(names), "query").select("item_id", "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
