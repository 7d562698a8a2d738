"""The whole pipeline: rows by stage, names that clash, order and lossless tokens."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("spanforge.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from spanforge.llm import pfair_mix, piece_bpe  # noqa: E402
from spanforge.llm.common import materialize  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["position", "_file", "_row", "n_deleted", "quality", "score", "row", "carried", "key", "th", "file", "a.b", "gone", "bin"]


def corpus():
    """Good prose, bad prose that the labels mark, copies, near copies and shared passages."""
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 8)))
    prose = lambda n: " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n))
    passage = prose(70)
    texts = [prose(rng.randrange(60, 160)) for _ in range(120)]
    texts += ["# $ % 0 1 " * rng.randrange(30, 80) for _ in range(40)]
    texts += [f"{prose(60)} {passage} {prose(60)}" for _ in range(8)]
    near = prose(400).split()
    for k in range(5):  # no run of 50 words is left in common, yet nine tenths of the text
        w = list(near)
        for at in range(40, 400, 46):
            w[at] = f"other{k}x{at}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[1]]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    return rows + [(None, prose(80), None, None, None), (900, None, "en", "src1", 0), (901, "", "en", "src1", 0)]


def first_of_groups(texts):
    """The smallest id of each component of texts whose sets of five-word shingles agree for 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    order = lambda i: (i is None, i or 0)
    for a in sets:
        for b in sets:
            if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=order)
                up[y] = x
    return {find(i) for i in sets}


def test_whole_run(spark, tmp_path):
    try:
        proto = piece_bpe.load()
    except OSError:
        pytest.skip("no model file")
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, int(not r[1].startswith("#")), 0) for i, r in enumerate(rows[:160]) if i % 2]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, kept, stages = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    # with columns whose names the stages use themselves
    kept = kept.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    for name, stage in pipeline.STAGES[:-1]:
        out = materialize(stage(spark, kept, d), name.replace(" ", "-"))
        assert out.columns == kept.columns
        assert out.select(*[F.col(f"`{c}`") for c in CLASH]).distinct().count() == 1
        stages.append((kept, out))
        kept = out
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    quality, lines, near, mixed = (tuple(map(texts, s)) for s in stages)
    assert not any((t or "").startswith("#") for t in quality[1].values()) and set(range(120)) <= quality[1].keys()
    # later copies of the passage go, and nothing of what stands once
    shared = [i for i in lines[0] if i is not None and 160 <= i < 168]
    assert all(lines[1][i] == lines[0][i] for i in lines[0] if i in range(2, 120) or i == shared[0])
    assert all(len(lines[1][i].split()) == len(lines[0][i].split()) - 70 for i in shared[1:])
    assert len(near[1].keys() & {168, 169, 170, 171, 172}) == 1
    assert near[1].keys() == first_of_groups(near[0])
    assert mixed[0] == mixed[1]
    tokens = {r["doc_id"]: r for r in pipeline.STAGES[-1][1](spark, kept, d).collect()}
    want = {r["doc_id"]: r["position"] for r in pfair_mix.places(stages[-1][0].select("doc_id", "source")).collect()}
    assert {i: r["position"] for i, r in tokens.items()} == want and all(r["lossless"] for r in tokens.values())
    back = {r["doc_id"]: r["text"] for r in piece_bpe.decode_documents(spark.createDataFrame([(i, r["ids"]) for i, r in tokens.items()], "doc_id long, ids array<int>"), proto).collect()}
    assert back == mixed[1]
    # run() gives the same rows
    done = pipeline.run(spark, d)
    assert {r["doc_id"]: (r["ids"], r["position"]) for r in done.collect()} == {i: (r["ids"], r["position"]) for i, r in tokens.items()}
