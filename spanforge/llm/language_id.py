"""Language identification by rank-order n-gram profiles.

A profile is the list of a text's most frequent character 1- to 3-grams, the most
frequent first (ties: the smaller code first). The distance of a document to a
language is the out-of-place measure: the sum, over the document's profile, of how
far each n-gram stands from its place in the language's profile; an n-gram that is
missing there counts the profile size. The nearest language wins, ties to the
alphabetically first.

Letters are lower-cased, every run of other characters is one blank, and the text
starts and ends with a blank; n-grams that hold a blank inside a word boundary
(middle of a 3-gram) are left out.

Defined cases: null text, or text without a letter: ``und`` with score 0. No
training rows: ``und`` everywhere. One learned language: score 1 minus its distance
over the greatest possible one. Repeated rows are scored one by one. Texts of any length
are read some characters at a time. Further columns of the input do not matter, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import spread

TOP = 300
MAX_DOCS_PER_LANG = 3000
TEXT_BLOCK = 1 << 20  # characters of a text at a time


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of all n-grams of ``text``, empty if it has no letter."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[raw]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    a = np.concatenate(([32], np.where(is_letter, raw, 32), [32])).astype(np.uint64)
    blank = a == 32
    a = a[~(blank & np.concatenate(([False], blank[:-1])))]
    two = (a[:-1] << np.uint64(21)) | a[1:]
    three = (two[:-1] << np.uint64(21)) | a[2:]
    return np.concatenate((a[a != 32], two, three[a[1:-1] != 32]))


def gram_counts(text: str | None, size: int = TEXT_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams, by code. Texts are cut at non-letters, which no n-gram spans."""
    parts, at, text = [], 0, text or ""
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end].isalpha():
            end += 1
        parts.append(np.unique(gram_codes(text[at:end]), return_counts=True))
        at = end
    if len(parts) < 2:
        return parts[0] if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


def profile(text: str | None, top: int = TOP) -> np.ndarray:
    """The codes of the ``top`` most frequent n-grams, by rank."""
    codes, counts = gram_counts(text)
    return codes[np.argsort(-counts, kind="stable")[:top]]


def learn_profiles(docs: DataFrame, train: Column, top: int = TOP, max_docs: int = MAX_DOCS_PER_LANG) -> dict[str, np.ndarray]:
    """Language -> n-gram codes by rank, from the rows where ``train`` holds.

    At most about ``max_docs`` rows of a language are read, chosen by a hash of
    doc_id; this bound is the size of the fitting sample. N-grams are counted on
    the executors, and only ``top`` codes of each language reach the driver.
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = {r["lang"]: max_docs / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    shares = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(min(1.0, v)))])
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < shares[F.col("lang")] * float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(gram_counts(text))
            for lang, parts in by.items():
                code, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in parts]), len(code))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counted = spread(rows.select("text", "lang")).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))  # cut to ``top`` before the shuffle
    best = counted.withColumn("place", place).filter(F.col("place") <= top).collect()
    out: dict[str, list] = {}
    for r in sorted(best, key=lambda r: r["place"]):
        out.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, np.uint64) for k, v in out.items()}


class Ranker:
    """Out-of-place distances to a set of language profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.names, self.top = sorted(profiles), top
        self.codes = np.unique(np.concatenate([profiles[n] for n in self.names])) if profiles else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), j] = np.arange(len(profiles[name]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        theirs = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))]
        apart = np.abs(theirs - np.arange(len(own), dtype=np.int32)[:, None])
        return np.where(theirs < 0, self.top, apart).sum(0)

    def judge(self, text: str | None) -> tuple[str, float]:
        own = profile(text, self.top)
        if not len(own) or not self.names:
            return "und", 0.0
        d = self.distances(own)
        best = int(d.argmin())
        if len(d) == 1:
            return self.names[0], max(0.0, 1.0 - float(d[0]) / (len(own) * self.top))
        second = float(np.partition(d, 1)[1])
        return self.names[best], (second - float(d[best])) / second if second else 0.0


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score (margin to the second language, 0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value, top)
        for b in batches:
            found = [ranker.judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
