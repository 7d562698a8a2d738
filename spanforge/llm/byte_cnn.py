"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the UTF-8 bytes of overlapping chunks that
together cover the whole document. Their outputs are rectified and max-pooled in each
chunk; mean, maximum and minimum over the chunks feed one logistic unit.

Defined cases: null and empty texts count as one chunk of zero bytes and get that
chunk's probability. Texts are padded with zero bytes to whole filter steps, so the last
bytes lie under a filter too. Very long texts are read some chunks at a time. Without
labelled rows of both classes every score is the share of label 1 (0.5 without any).
Repeated rows are scored one by one, ties have no meaning here, further columns, also one
named ``score``, do not matter, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import at_random, spread

WIDTH, STEP, FILTERS = 8, 3, 24
CHUNK, OVERLAP = 512, 32
PER, HOP = (CHUNK - WIDTH) // STEP + 1, (CHUNK - OVERLAP) // STEP  # filter positions of a chunk, and from one chunk to the next
GROUP = 512  # chunks at a time, so that a text of any length needs bounded memory
MAX_TRAIN_DOCS = 1600


class ByteCnn:
    """Filter tables ``taps[j, byte, filter]``, and the logistic unit on top."""

    def __init__(self, seed: int = 0, filters: int = FILTERS):
        rng = np.random.default_rng(seed)
        self.taps = rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.top = np.zeros(3 * filters, np.float32)
        self.base = np.zeros(1, np.float32)

    @staticmethod
    def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, padded so that the last filter position ends with them, and the first position of each chunk."""
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        pad = max(WIDTH - len(raw), 0) or (WIDTH - len(raw)) % STEP
        if pad:
            raw = np.concatenate((raw, np.zeros(pad, np.uint8)))
        last = (len(raw) - WIDTH) // STEP + 1
        return raw, np.arange(0, max(last - (PER - HOP), 1), HOP)

    def _responses(self, raw: np.ndarray) -> np.ndarray:
        n = (len(raw) - WIDTH) // STEP + 1
        out = self.taps[0][raw[0 : (n - 1) * STEP + 1 : STEP]]
        for j in range(1, WIDTH):
            out += self.taps[j][raw[j : j + (n - 1) * STEP + 1 : STEP]]
        return out

    def pooled(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Chunks x filters: the greatest response of each filter in each chunk, some chunks at a time."""
        out = np.empty((len(starts), self.taps.shape[2]), np.float32)
        for at in range(0, len(starts), GROUP):
            own = starts[at : at + GROUP]
            z = self._responses(raw[own[0] * STEP : (own[-1] + PER - 1) * STEP + WIDTH])
            local = own - own[0]
            top = np.maximum.reduceat(z, local, axis=0)
            if len(own) > 1:  # a chunk also holds the first positions of the next one
                head = np.stack([z[s : s + PER - HOP].max(0) for s in local[1:]])
                top[:-1] = np.maximum(top[:-1], head)
            out[at : at + GROUP] = top
        return np.maximum(out + self.bias, 0)

    def _tops(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest response of each filter in each chunk (without bias), and its position."""
        n = (len(raw) - WIDTH) // STEP + 1
        top, where = (np.empty((len(starts), self.taps.shape[2]), t) for t in (np.float32, np.int64))
        for at in range(0, len(starts), GROUP):
            pos = starts[at : at + GROUP, None] + np.arange(PER)
            inside = pos < n
            pos = np.minimum(pos, n - 1)
            z = self.taps[0][raw[pos * STEP]]
            for j in range(1, WIDTH):
                z += self.taps[j][raw[pos * STEP + j]]
            z[~inside] = -np.inf
            best = z.argmax(1)
            top[at : at + GROUP] = np.take_along_axis(z, best[:, None], 1)[:, 0]
            where[at : at + GROUP] = starts[at : at + GROUP, None] + best
        return top, where

    def probability(self, text: str | None) -> float:
        p = self.pooled(*self.chunks(text))
        x = np.concatenate((p.mean(0), p.max(0), p.min(0)))
        return float(1 / (1 + np.exp(-np.clip(float(x @ self.top + self.base[0]), -30, 30))))

    def gradient(self, prepared: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, by taps, bias, top and base; each maximum passes it on to its position."""
        nf = self.taps.shape[2]
        tops, places = zip(*[self._tops(*x) for x in prepared], strict=True)
        sizes = np.array([len(t) for t in tops])
        ends = np.cumsum(sizes)
        begin = ends - sizes
        p = np.maximum(np.concatenate(tops) + self.bias, 0)
        mean = np.add.reduceat(p, begin) / sizes[:, None]
        high, low = np.maximum.reduceat(p, begin), np.minimum.reduceat(p, begin)
        x = np.concatenate((mean, high, low), 1)
        out = 1 / (1 + np.exp(-np.clip(x @ self.top + self.base, -30, 30)))
        g = ((out - y) / len(y)).astype(np.float32)
        gx = g[:, None] * self.top
        doc = np.repeat(np.arange(len(y)), sizes)
        ends_at = [(p == x[doc]).astype(np.float32) for x in (high, low)]
        most, least = (e / np.add.reduceat(e, begin)[doc] for e in ends_at)  # equal chunks share
        gp = gx[doc, :nf] / sizes[doc, None]
        gp = gp + gx[doc, nf : 2 * nf] * most + gx[doc, 2 * nf :] * least
        gp = np.where(p > 0, gp, 0)
        cells = np.empty((WIDTH, *p.shape), np.int64)
        for (raw, _), where, a, e in zip(prepared, places, begin, ends, strict=True):
            for j in range(WIDTH):
                cells[j, a:e] = raw[where * STEP + j]
        cells = cells * nf + np.arange(nf)
        taps = np.stack([np.bincount(c.ravel(), gp.ravel(), 256 * nf).reshape(256, nf) for c in cells])
        return [taps, gp.sum(0), x.T @ g, np.array([g.sum()])]

    def fit(self, texts: list[str | None], labels: list[int], epochs: int = 12, rate: float = 0.01, batch: int = 32, seed: int = 0) -> "ByteCnn":
        """Adam on the log loss, over the same chunks that scoring reads: all of them."""
        y = np.asarray(labels, np.float32)
        share = float(y.mean()) if len(y) else 0.5
        self.base[0] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        if len(set(labels)) < 2:
            if not len(y):
                self.base[0] = 0
            return self
        rng = np.random.default_rng(seed)
        prepared = [self.chunks(t) for t in texts]
        self.top += rng.normal(0, 0.1, self.top.shape).astype(np.float32)
        params = [self.taps, self.bias, self.top, self.base]
        decay = [1e-5, 0, 1e-4, 0]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(prepared))
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                grads = self.gradient([prepared[i] for i in ids], y[ids])
                step += 1
                lr = rate * min(1, 2 * (1 - epoch / epochs))
                for k, (w, d) in enumerate(zip(params, grads, strict=True)):
                    d = d + decay[k] * w
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.99 * second[k] + 0.01 * d * d
                    w -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def train(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> ByteCnn:
    """A network fitted to (doc_id, text, label); at most ``max_docs`` rows, by a hash of doc_id.

    Rows with a null label are left out; equal rows of one doc_id count once.
    """
    rows = at_random("doc_id", max_docs, labelled.filter(F.col("label").isNotNull()).select("doc_id", "text", F.col("label").cast("int").alias("label"))).collect()
    rows = sorted({(r["doc_id"], r["text"] or "", r["label"]) for r in rows})
    return ByteCnn().fit([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, model: ByteCnn, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id by default) and the score, called ``name``, of every row."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").cast("string").alias("text_"))
    schema = rows.drop("text_").schema.add("score_", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            p = pa.array([net.probability(t) for t in b.column("text_").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], p], names=[*names, "score_"])

    done = spread(rows).mapInArrow(run, schema)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("score_").alias(name))
