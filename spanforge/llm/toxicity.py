"""Toxicity by weak supervision.

1. Lexicon voters are mined from labelled rows: a word or a word's first letters, with
   the least number of times it must occur, whose documents are toxic far more often
   than others. Pattern voters look at the share of hits, shouting, masked words and
   repeated words. A voter says 1, 0 or nothing.
2. A generative model of the votes estimates each voter's accuracy by expectation
   maximisation, starting from the voters alone (no labels). Voters that agree beyond
   what the class explains are correlated; each voter's evidence is divided by the sum
   of its correlations, so that many forms of one stem do not count many times.
3. A linear classifier is trained on the posterior labels, over log densities of the
   lexicon and the patterns. Its probability is the score.

Defined cases: null text counts as empty; empty texts get the classifier's probability
without any hit. Without labelled rows of both classes the lexicon is empty, and every
score is the share of label 1 (0 without any). Rows are scored one by one, repeated ones
too, texts of any length in blocks; further columns do not matter, and an empty table gives
an empty result. Labels, lang, source and doc_id are no inputs of a
score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import at_random, spread

MAX_TRAIN_DOCS = 6000
MAX_VOTERS = 400
STEMS = (4, 5, 6, 7)
TIMES = (1, 2, 4)
TEXT_BLOCK = 1 << 20  # characters of a text at a time
_BLANK = re.compile(r"\s")
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b\w[*@#$]+\w|\b\w[*@#$]{2,}")


def tokens(text: str | None, size: int = TEXT_BLOCK) -> Counter[str]:
    """Words and their counts, of some characters at a time; cuts are at white space."""
    text, at, out = text or "", 0, Counter()
    while at < len(text):
        cut = _BLANK.search(text, at + size) if at + size < len(text) else None
        end = cut.end() if cut else len(text)
        out.update(_WORD.findall(text[at:end].lower()))
        at = end
    return out


def forms(word: str) -> list[str]:
    """The word, and its beginnings (marked by a trailing ``*``)."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def form_counts(words: Counter[str]) -> Counter[str]:
    out: Counter[str] = Counter()
    for w, n in words.items():
        for f in forms(w):
            out[f] += n
    return out


class Model:
    """Mined voters, their accuracies, and the classifier."""

    def __init__(self) -> None:
        self.lexicon: dict[str, int] = {}
        self.times: list[tuple[str, int]] = []
        self.weights = np.zeros(0)
        self.base = -20.0
        self.known: dict[str, tuple[int, ...]] = {}

    # features

    def _of(self, word: str) -> tuple[int, ...]:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = tuple(self.lexicon[f] for f in forms(word) if f in self.lexicon)
        return self.known[word]

    def counts(self, text: str | None) -> tuple[np.ndarray, int, np.ndarray]:
        """Count of each lexicon form, number of words, and the patterns' shares."""
        words = tokens(text)
        out = np.zeros(len(self.lexicon))
        known, hits = self.known, 0
        for w, n in words.items():
            own = known.get(w)
            if own is None:
                own = self._of(w)
            if own:
                hits += n
                for k in own:
                    out[k] += n
        total = sum(words.values())
        raw = text or ""
        return out, total, np.array([hits / max(total, 1), raw.count("!!") / max(total, 1), len(_MASKED.findall(raw)) / max(total, 1) if "*" in raw or "@" in raw else 0.0, 1 - len(words) / max(total, 1)])

    def features(self, counts: np.ndarray, total: int, shares: np.ndarray) -> np.ndarray:
        return np.concatenate((np.log1p(1000 * counts / max(total, 20)), np.log1p(100 * shares)))

    def votes(self, counts: np.ndarray, total: int, shares: np.ndarray) -> np.ndarray:
        """1 or 0 by each voter, or -1 for nothing."""
        lex = np.array([1 if counts[self.lexicon[f]] >= t else -1 for f, t in self.times])
        patterns = [
            1 if shares[0] >= 0.015 else (0 if shares[0] < 0.004 else -1),  # share of lexicon hits
            1 if shares[0] >= 0.05 else -1,
            0 if shares[0] == 0 else -1,  # no hit at all
            1 if shares[2] >= 0.05 else -1,  # masked words
            0 if shares[3] > 0.9 and shares[0] < 0.02 else -1,  # a few words again and again
        ]
        return np.concatenate((lex, patterns)).astype(int)

    # fitting

    def mine(self, docs: list[Counter[str]], labels: np.ndarray) -> None:
        """Voters whose documents are mostly toxic, best first."""
        pos, neg = Counter(), Counter()
        for words, y in zip(docs, labels, strict=True):
            seen = form_counts(words)
            (pos if y else neg).update((f, t) for f, n in seen.items() for t in TIMES if n >= t)
        n_pos, n_neg = max(int(labels.sum()), 1), max(int((1 - labels).sum()), 1)
        rated = []
        for key, a in pos.items():
            b = neg[key]
            lift = np.log((a + 0.5) / (n_pos + 1)) - np.log((b + 0.5) / (n_neg + 1))
            if a >= 4 and lift > 2.5 and a > 0.6 * (a + b):
                rated.append((a * lift, key))
        rated.sort(key=lambda x: (-x[0], x[1]))
        self.times = [key for _, key in rated[:MAX_VOTERS]]
        self.lexicon = {f: i for i, f in enumerate(dict.fromkeys(f for f, _ in self.times))}
        self.known = {}

    @staticmethod
    def _shared(resid: np.ndarray, least: float) -> np.ndarray:
        """Per voter the sum of its correlations of ``least`` or more, its own included."""
        cov = resid.T @ resid / max(len(resid), 1)
        sd = np.sqrt(np.diag(cov)) + 1e-6
        corr = np.clip(cov / sd[:, None] / sd, 0, 1)
        np.fill_diagonal(corr, 1)
        corr[corr < least] = 0
        return corr.sum(1)

    @staticmethod
    def label_model(votes: np.ndarray, share: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior of each row; per voter the rates of 1/0/nothing by class; and its redundancy.

        votes: rows x voters of 1, 0, -1.
        """
        n, m = votes.shape
        said = np.stack([votes == v for v in (1, 0, -1)], 2).astype(float)
        fired = (votes == 1).astype(float) - (votes == 0)
        # voters that nearly always say the same count as one from the start, else they would become the class
        spare = Model._shared(fired - fired.mean(0), 0.98)
        lean = fired @ (1 / spare)
        q = np.where(lean > 0, 0.9, np.where(lean < 0, 0.02, share))
        rates = np.zeros((m, 3, 2))
        for k in range(rounds):
            for c, w in ((1, q), (0, 1 - q)):
                rates[:, :, c] = (np.einsum("n,nmv->mv", w, said) + 0.5) / (w.sum() + 1.5)
            if k in (2, 8):  # correlations given the class, from the residuals
                mean1, mean0 = (q @ fired) / max(q.sum(), 1e-9), ((1 - q) @ fired) / max((1 - q).sum(), 1e-9)
                spare = Model._shared(fired - q[:, None] * mean1 - (1 - q)[:, None] * mean0, 0.1)
            log = np.log(rates[:, :, 1]) - np.log(rates[:, :, 0])
            evidence = np.einsum("nmv,mv->n", said, log / spare[:, None])
            prior = np.log(share / (1 - share))
            q = 1 / (1 + np.exp(-np.clip(evidence + prior, -30, 30)))
        return q, rates, spare

    def fit(self, texts: list[str | None], labels: list[int], rounds: int = 300) -> "Model":
        y = np.asarray(labels, float)
        share = float(y.mean()) if len(y) else 0.0
        self.base = float(np.log(share / (1 - share))) if 0 < share < 1 else (20.0 if share else -20.0)
        if not 0 < share < 1:
            return self
        self.mine([tokens(t) for t in texts], y)
        parts = [self.counts(t) for t in texts]
        x = np.array([self.features(*p) for p in parts])
        votes = np.array([self.votes(*p) for p in parts])
        q, self.rates, self.spare = self.label_model(votes, share)
        self.posterior = q
        w, b = np.zeros(x.shape[1]), self.base
        first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for k in range(1, rounds + 1):  # Adam on the log loss against the posteriors
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            g = np.append(x.T @ (p - q) / len(q) + 3e-4 * w, (p - q).mean())
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            move = 0.05 * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        self.weights, self.base = w, float(b)
        return self

    def score(self, text: str | None) -> float:
        z = self.base
        if len(self.weights):
            z += float(self.features(*self.counts(text)) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """A model fitted to (doc_id, text, label); at most ``max_docs`` rows, by a hash of doc_id.

    Rows with a null label are left out; equal texts with equal labels count once.
    """
    rows = at_random("doc_id", max_docs, labelled.filter(F.col("label").isNotNull()).select("doc_id", "text", F.col("label").cast("int").alias("label"))).collect()
    rows = sorted({(r["text"] or "", r["label"]) for r in rows})
    return Model().fit([r[0] for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    model.known = {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, score double")
