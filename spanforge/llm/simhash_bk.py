"""SimHash near-duplicates, found with Burkhard-Keller trees.

A document's fingerprint has a bit set where over half of its shingles' 64-bit hashes
(XXH64 of the UTF-8 bytes, seed 42) have it set; fingerprints of more than 64 bits take
further words from mixed copies of the same hashes. Two fingerprints link when at
most ``radius`` bits differ, and a component is what links reach.

Fingerprints are dealt to shards by bands of their bits. With more bands than radius,
two linked fingerprints are equal in one band at least, so searching the shard of each
band misses nothing; with fewer, a pair is missed with the small probability that all
bands differ. Each shard is one BK-tree: a node's children are keyed by their Hamming
distance to it, and a search follows only the edges whose key lies within the radius of
the distance to the node. A task holds the trees of its shards. Shards over
``SHARD_LIMIT`` fingerprints are cut into parts, and each pair of parts is a tree with
its searchers, so no row is dropped and no task holds more than two parts.

A shard gives a spanning forest of its links, never all pairs; components are then
joined by repeated minimum labels in Spark. Equal fingerprints are one class from the
start, so a group of exact copies is one row in all of this.

Defined cases: null and empty texts and texts without a word have fingerprint zero,
linked like any other; texts of fewer words than a shingle are one shingle. Repeated
rows and equal doc_ids are kept; the smallest doc_id represents a class. Null doc_ids
take part, but never represent a class that has another. An empty table gives an empty
result. Further columns, of whatever names, do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, spread

SHARD_LIMIT = 4096
SEARCH_BLOCK = 1024
TEXT_BLOCK = 1 << 22  # bytes of a text at a time, so that a text of any length needs bounded memory
_BLANK = re.compile(rb"[ \t\n\x0b\f\r]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_blocks(text: str | None, k: int, size: int = TEXT_BLOCK) -> Iterator[np.ndarray]:
    """XXH64, seed 42, of each ``k``-word shingle, repeats included, of some bytes of the text at a time."""
    raw = (text or "").encode("utf-8", "replace")
    at, held, any_yet = 0, [], False
    digest = xxhash.xxh64_intdigest
    while at < len(raw):
        cut = _BLANK.search(raw, at + size) if at + size < len(raw) else None
        end = cut.end() if cut else len(raw)
        words = held + raw[at:end].lower().split()
        at = end
        if len(words) < k:
            held = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
        yield np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - k + 1)
        held, any_yet = words[len(words) - k + 1 :], True
    if held and not any_yet:
        yield np.array([digest(b" ".join(held), 42)], np.uint64)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The hashes of all blocks."""
    return np.concatenate([np.empty(0, np.uint64), *hash_blocks(text, k)])


def fingerprint(text: str | None, k: int = 3, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; the first is the plain SimHash."""
    return of_hashes(hash_blocks(text, k), words)


def of_hashes(blocks: Iterator[np.ndarray], words: int) -> np.ndarray:
    counts, n = np.zeros((words, 64), np.int64), 0
    for h in blocks:
        n += len(h)
        for w in range(words):
            if w:
                h = h * _MIX + np.uint64(w)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            counts[w] += np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, fp (array of ``words`` longs) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            fp = np.concatenate([fingerprint(t, shingle, words) for t in texts]) if texts else np.empty(0, np.uint64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * words, pa.int32()), pa.array(fp.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], names=["doc_id", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, fp array<long>")


class BkForest:
    """BK-trees of many shards in flat arrays, built and searched level by level."""

    def __init__(self, points: np.ndarray, shard: np.ndarray):
        """points: n x words of uint64, no two of one shard equal; shard: n ids."""
        self.points = points
        n = len(points)
        _, first, back = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[back]
        edges: list[np.ndarray] = []  # parent * width + distance
        child: list[np.ndarray] = []
        self.width = points.shape[1] * 64 + 1
        left = np.flatnonzero(self.root != np.arange(n))
        at = self.root[left]
        while len(left):
            key = at * self.width + self._apart(left, at)
            keys, first, back = np.unique(key, return_index=True, return_inverse=True)
            edges.append(keys)
            child.append(left[first])
            at = left[first][back]
            rest = at != left
            left, at = left[rest], at[rest]
        self.edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
        self.child = np.concatenate(child) if child else np.empty(0, np.int64)
        order = np.argsort(self.edge, kind="stable")
        self.edge, self.child = self.edge[order], self.child[order]

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.points[a] ^ self.points[b]).sum(1, dtype=np.int64)

    def search(self, query: np.ndarray, who: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in ``who``, node) of all points within the radius, some at a time."""
        node = root
        while len(who):
            d = np.bitwise_count(query[who] ^ self.points[node]).sum(1, dtype=np.int64)
            hit = d <= radius
            yield who[hit], node[hit]
            lo = np.searchsorted(self.edge, node * self.width + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edge, node * self.width + np.minimum(d + radius, self.width - 1), side="right")
            size = hi - lo
            who = np.repeat(who, size)
            node = self.child[np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] if size.sum() else np.empty(0, np.int64)


class Groups:
    """Union by smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            x = y

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            both = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), 1), axis=0)
            a, b = both[:, 0], both[:, 1]
            np.minimum.at(self.up, a, b)


def forest_links(points: np.ndarray, shard: np.ndarray, build: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect just what links within the shards connect.

    ``build`` marks the points that are in their shard's tree; all points search it.
    """
    inside = np.flatnonzero(build)
    if not len(inside):
        return inside, inside
    tree = BkForest(points[inside], shard[inside])
    groups = Groups(len(points))
    shards, first = np.unique(shard[inside], return_index=True)
    at = np.minimum(np.searchsorted(shards, shard), len(shards) - 1)
    searchers = np.flatnonzero(shards[at] == shard)
    sizes = np.bincount(at[searchers], minlength=len(shards))
    guests = np.bincount(at[searchers], weights=~build[searchers], minlength=len(shards))
    # alone in a shard there is nothing to find; in a pair of parts only the guests search
    searchers = searchers[(sizes[at[searchers]] > 1) & (~build[searchers] | (guests[at[searchers]] == 0))]
    for k in range(0, len(searchers), SEARCH_BLOCK):
        own = searchers[k : k + SEARCH_BLOCK]
        for who, node in tree.search(points[own], np.arange(len(own)), first[at[own]], radius):
            groups.join(own[who], inside[node])
    root = groups.find(np.arange(len(points)))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return linked, root[linked]


def band_values(fp: np.ndarray, band_bits: int, layouts: int) -> np.ndarray:
    """n x bands: band number * 2**band_bits + the band's bits; fp: n x words.

    The first layout cuts the bits in order, the second takes every (bits / band_bits)-th.
    """
    n, words = fp.shape
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, words * 8), axis=1, bitorder="little")
    count = words * 64 // band_bits
    bits = bits[:, : count * band_bits]
    weight = np.int64(1) << np.arange(band_bits, dtype=np.int64)
    cut = [bits.reshape(n, count, band_bits), bits.reshape(n, band_bits, count).transpose(0, 2, 1)][:layouts]
    return np.concatenate([x @ weight for x in cut], 1) + (np.arange(count * layouts, dtype=np.int64) << np.int64(band_bits))


def dealt(classes: DataFrame, band_bits: int, layouts: int, limit: int) -> DataFrame:
    """cid, fp, further columns, shard, lo, hi, build: every class in the shard of each of its bands.

    Shards over ``limit`` are cut into parts, and lo, hi is a pair of parts; ``build`` marks the
    part whose points are in the tree. Rows of one (shard, lo, hi) are together and sorted by cid.
    """
    names = classes.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fp = b.column("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(b.num_rows, -1)
                shards = band_values(fp, band_bits, layouts)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1) * shards.shape[1], pa.int32()), pa.array(shards.ravel()))], names=[*names, "shards"])

    cut_rows = classes.mapInArrow(cut, ", ".join(f"{c} {t}" for c, t in classes.dtypes) + ", shards array<long>")
    rows = cut_rows.select(*names, F.explode("shards").alias("shard"))
    large = rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("shard", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    rows = rows.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select(*names, "shard", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") <= F.col("other")).alias("build"))
    return rows.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi", "cid")  # the least id of a group is its root in every band


def whole_shards(batches: Iterator[pa.RecordBatch], more: list[str] | None = None) -> Iterator[list[np.ndarray]]:
    """cid, fp, key (of shard and parts), build and the columns ``more``, with all rows of a key together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        fp = batch.column("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
        shard, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "lo", "hi"))
        key = (shard << 32) | (lo << 16) | hi  # parts of a shard under 2**16
        held.append([batch.column("cid").to_numpy(zero_copy_only=False), fp, key, batch.column("build").to_numpy(zero_copy_only=False), *(batch.column(c).to_numpy(zero_copy_only=False) for c in more or [])])
        if sum(len(x[0]) for x in held) >= 40_000:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.flatnonzero(cols[2] == cols[2][-1])[0])  # the last shard may go on
            if cut:
                yield [c[:cut] for c in cols]
            held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def links(classes: DataFrame, radius: int, band_bits: int = 16, layouts: int = 1, limit: int = SHARD_LIMIT) -> DataFrame:
    """a, b (class ids) of edges that connect what links connect; classes: cid long, fp array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, fp, key, build in whole_shards(batches):
            a, b = forest_links(fp, key, build, radius)
            yield pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b])], names=["a", "b"])

    return dealt(classes.select("cid", "fp"), band_bits, layouts, limit).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """cid, root: the smallest id that edges (a, b) reach, for every id with an edge.

    Each round gives every id the least label of its neighbours and then the label of
    its label; both sides of a join are plain columns, so a large star is split by the
    adaptive skew join. Ends when a round changes nothing.
    """
    links = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    # one contraction first: each id keeps the link to its least neighbour, and the others move there
    near = links.groupBy("a").agg(F.min("b").alias("r"))
    moved = links.join(near, "a").filter("b <> r").select(F.greatest("b", "r").alias("a"), F.least("b", "r").alias("b"))
    few = near.withColumnRenamed("r", "b").union(moved).distinct()
    both = materialize(few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("cid"), F.least("a", "low").alias("root"))
    label = materialize(label, "labels")
    while True:
        near = both.join(label.select(F.col("cid").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        one = label.join(near.select(F.col("a").alias("cid"), "r"), "cid").select("cid", F.least("root", "r").alias("next"), F.col("root").alias("was"))
        jump = one.select(F.col("cid").alias("next"), F.col("next").alias("far"))
        two = one.join(jump, "next", "left").select("cid", F.least("next", F.coalesce("far", "next")).alias("root"), "was")
        two = materialize(two, "labels")
        label = two.select("cid", "root")
        if two.filter(F.col("root") != F.col("was")).isEmpty():
            return label


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, bits: int = 64, band_bits: int = 16, layouts: int = 1, limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the component) for every row."""
    fps = materialize(fingerprints(docs, shingle, bits // 64), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # a doc_id that several texts share cannot name a class, so a hash of the fingerprint does; a clash would only send two classes to the same label
    cid = F.col("fp")[0] if bits == 64 else F.xxhash64("fp")
    classes = materialize(classes.select(cid.alias("cid"), "fp", "rep"), "classes")
    root = components(links(classes.select("cid", "fp"), radius, band_bits, layouts, limit))
    of = classes.select("cid", "fp", "rep").join(root, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


# documents that are similar as sets of shingles: candidates by fingerprints, decided exactly

SET_WORDS, SET_BAND, SET_LAYOUTS, SET_RADIUS = 4, 16, 2, 52
STAR = 64
FILTER_BITS = 1 << 25


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def set_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (text hash), cid (hash of the shingle set), fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            fp = np.zeros((len(texts), SET_WORDS), np.uint64)
            cid = np.zeros(len(texts), np.uint64)
            for i, t in enumerate(texts):
                own = shingle_set(t, shingle)
                fp[i], cid[i] = of_hashes(iter((own,)), SET_WORDS), xxhash.xxh64_intdigest(own.tobytes())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * SET_WORDS, pa.int32()), pa.array(fp.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(cid.view(np.int64)), rows], names=["doc_id", "th", "cid", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, th long, cid long, fp array<long>")


def _meetings(points: np.ndarray, shard: np.ndarray, build: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (searcher, point of a tree) of the pairs within the radius, some shards at a time."""
    inside = np.flatnonzero(build)
    if not len(inside):
        return
    tree = BkForest(points[inside], shard[inside])
    shards, first = np.unique(shard[inside], return_index=True)
    at = np.minimum(np.searchsorted(shards, shard), len(shards) - 1)
    searchers = np.flatnonzero(shards[at] == shard)
    sizes = np.bincount(at[searchers], minlength=len(shards))
    guests = np.bincount(at[searchers], weights=~build[searchers], minlength=len(shards))
    searchers = searchers[(sizes[at[searchers]] > 1) & (~build[searchers] | (guests[at[searchers]] == 0))]
    for k in range(0, len(searchers), SEARCH_BLOCK):
        own = searchers[k : k + SEARCH_BLOCK]
        hits = [(own[who], inside[node]) for who, node in tree.search(points[own], np.arange(len(own)), first[at[own]], radius)]
        a, b = (np.concatenate(x) for x in zip(*hits, strict=True))
        apart = a != b
        yield a[apart], b[apart]


def candidates(classes: DataFrame, limit: int = SHARD_LIMIT, star: int | None = STAR) -> DataFrame:
    """a, b, hot: pairs of classes whose fingerprints lie within the radius and agree in a band.

    classes: cid, fp and, without ``star``, root. Every pair is given once, from the first band
    in which it agrees. Points that more than ``star`` others meet in a shard are ``hot``: of
    their pairs only those with the point that most meet, and with the nearest one, are given.
    Without ``star`` all pairs of different roots are given.
    """
    has_root = "root" in classes.columns
    rows = dealt(classes.select("cid", "fp", *(["root"] if has_root else [])), SET_BAND, SET_LAYOUTS, limit)

    def pairs(cid: np.ndarray, fp: np.ndarray, key: np.ndarray, build: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        bands = band_values(fp, SET_BAND, SET_LAYOUTS)
        band = key >> 32 >> SET_BAND
        for a, b in _meetings(fp, key, build, SET_RADIUS):
            first = (bands[a] == bands[b]).argmax(1) == band[a]
            a, b = a[first], b[first]
            hot = np.zeros(len(a), bool)
            if has_root:
                keep = root[a] != root[b]
            elif len(a):
                met = np.bincount(np.concatenate((a, b)), minlength=len(cid))
                hot = np.maximum(met[a], met[b]) > star
                apart = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64)
                keep = ~hot
                for rank in (-met[b], apart):  # of each searcher: its most met partner, and its nearest
                    order = np.lexsort((cid[b], rank, a))
                    keep[order[np.append(True, a[order][1:] != a[order][:-1])]] = True
            else:
                keep = hot
            a, b, hot = cid[a[keep]], cid[b[keep]], hot[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(hot)], names=["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_shards(batches, ["root"] if has_root else []):
            yield from pairs(*cols[:4], cols[4] if has_root else cols[0])

    return rows.mapInArrow(run, "a long, b long, hot boolean").groupBy("a", "b").agg(F.max("hot").alias("hot"))


def only_of(texts: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``key`` is in ``wanted`` (and few others), so that few texts are shuffled.

    The filter is a bitmap of bounded size over hashes; a clash only lets a row pass.
    """
    bit = F.pmod(F.xxhash64(F.lit(1), key), F.lit(FILTER_BITS))
    found = wanted.select(bit.alias("bit")).groupBy(F.expr("bit div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS // 32, np.uint32)
    held[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("bit").to_numpy()
            yield b.filter(pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))

    return texts.withColumn("bit", bit).mapInArrow(run, texts.withColumn("bit", bit).schema).drop("bit")


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs a, b whose whole shingle sets have a Jaccard similarity of ``least``; texts: cid, text."""
    one, two = (texts.select(F.col("cid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b").sortWithinPartitions("b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for i, (b, x, y) in enumerate(zip(batch.column("b").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)):
                if b != last:
                    last, held = b, shingle_set(y, shingle)
                own = shingle_set(x, shingle)
                both = len(np.intersect1d(own, held, assume_unique=True))
                if both >= least * (len(own) + len(held) - both) - 1e-9:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, limit: int = SHARD_LIMIT, star: int = STAR) -> DataFrame:
    """doc_id, th (text hash), component_id (smallest doc_id of the component), root (its key, never null) for every row.

    Two texts link when their sets of shingles have a Jaccard similarity of ``least`` or more,
    and a component is what links reach. Candidates come from the BK-trees of 256-bit
    fingerprints: within ``SET_RADIUS`` bits, and equal in one of 64 bands of 16 bits; at a
    similarity of 0.8 a pair meets both with a probability of about 0.98. Every candidate is
    decided by the two whole sets, so no other texts are linked.

    Points with many partners are first compared with the most met and the nearest only; then
    their pairs that lie in no common component yet are all compared.
    """
    rows = materialize(set_fingerprints(docs, shingle), "set-fingerprints")
    classes = rows.groupBy("cid").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("fp").alias("fp"), F.min("doc_id").alias("least"))
    classes = materialize(classes, "classes")
    own = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))

    def decided(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        reps = materialize(classes.join(ids, "cid", "left_semi").select("cid", F.col("rep.th").alias("th")), "reps")
        # equal texts are one class, so any of them will do
        texts = only_of(own, "th", reps.select("th")).dropDuplicates(["th"]).join(reps, "th").select("cid", "text")
        return materialize(similar(pairs, materialize(texts, "texts"), shingle, least), "links")

    pairs = materialize(candidates(classes.select("cid", "fp"), limit, star), "pairs")
    links_ = decided(pairs)
    root = components(links_)
    hot = pairs.filter("hot").select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    labelled = classes.select("cid", "fp").join(hot, "cid", "left_semi").join(root, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    labelled = materialize(labelled, "hot")
    if not labelled.isEmpty():
        more = materialize(candidates(labelled, limit, None), "pairs")
        root = components(links_.unionByName(decided(more)))
    of = classes.select("cid", "least").join(root, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(names, "root").select("cid", "root", "component_id")
    return rows.select("doc_id", "th", "cid").join(of, "cid").select("doc_id", "th", "component_id", "root")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
