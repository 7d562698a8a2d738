"""Cases in which the training-data operators once did less than the whole job."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("spanforge.llm")

from spanforge.llm import pfair_mix, simhash_bk, threshold_topk  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def test_near_duplicates_are_those_of_jaccard_08(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    texts = ["", None, "a b", "A  b", "one two three"]
    for i in range(30):  # edited copies around and below the threshold, and one group with a common passage
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 120, 200]))]
        if i % 3 == 0:
            base[:20] = [f"common{k}" for k in range(20)]
        texts.append(" ".join(base))
        for edits in range(1, 7):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = frame(spark, texts)
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    near = 0
    for a in range(len(texts)):
        for b in range(a):
            same, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            near += 0.7 * both <= same < 0.8 * both
            if same * 5 >= both * 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(texts))}
    assert near > 20 and len(set(want.values())) < len(texts) - 20
    for limit, star in ((4096, 64), (64, 4)):
        got = {r["doc_id"]: r["component_id"] for r in simhash_bk.similar_documents(docs, limit=limit, star=star).collect()}
        pairs = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
        assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)  # recall
        assert all(want[a] == want[b] for a, b in got.items())  # no other texts are linked
    kept = {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(got.values())
    assert simhash_bk.similar_documents(docs.limit(0)).count() == 0


def test_rows_without_or_with_one_doc_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (None, text(3)), (None, text(3)), (None, text(4)), (2, text(4)), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", __import__("pyspark").sql.functions.lit(1))
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted([(1, text(1)), (1, text(2)), (0, text(3)), (2, text(4)), (3, "")])
    assert pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_mixed_order_reaches_the_tokens(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [f"text {i} " + "word " * (i * 37 % 400) for i in range(300)]
    docs = frame(spark, texts)
    want = {r["doc_id"]: r["position"] for r in pfair_mix.places(docs).collect()}
    path = str(tmp_path / "mixed")
    mixed = pfair_mix.schedule(docs).repartitionByRange(7, "position").sortWithinPartitions("position")
    mixed.select(*docs.columns).write.parquet(path)
    got = pipeline.tokenize(spark, spark.read.parquet(path), str(tmp_path)).collect()
    assert {r["doc_id"]: r["position"] for r in got} == want and len(got) == len(texts)
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 1


def test_repeated_vectors_count_once(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(80, 8)).astype(np.float32)
    ids = list(range(80))
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    w = np.floor(64 * x.astype(float)).astype(int)
    first = np.lexsort((np.arange(80), -(w @ w[0])))
    often = [int(i) for i in first if i][:3]
    rows += [rows[i] for i in often for _ in range(30)] + [rows[0]] * 3
    also = [float(c) for c in x[often[0]] + np.float32(2**-12)]  # same id, another vector of the same whole numbers or nearly so
    rows += [(often[0], also)] * 2
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = threshold_topk.search(frame_, k=6, entry_limit=64).collect()
    every = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    for q in range(0, 80, 20):
        true = sorted({(-int(v @ w[q]), i) for i, v in every if i != q})[:6]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(true)]
    # rows of one id that differ but score the same are one neighbour
    lists = threshold_topk.SortedLists(np.array([1, 1, 1, 2, 3]), np.array([[5, 0], [5, 1], [5, 2], [4, 0], [3, 0]]))
    assert lists.top(np.array([1, 0]), -1, 2)[0].tolist() == [1, 2]
