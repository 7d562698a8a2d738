"""The Merkle manifest, ranked search and multiset fingerprints against plain loops, and their defined edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spanforge.llm")

from spanforge.llm import block_max, merkle_paths, multiset_hash, registry  # noqa: E402
from spanforge.llm.common import numbered  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "A\n\nb", "日本 text 😀\n", "Word word " * 3000, "same\nSAME", "same\nSAME", "\x00Nul"]


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def odd_rows(n):
    """Documents with nulls in every column, repeated rows and ids, and a lang that holds most rows."""
    rng = random.Random(n)
    rows = [(i, ODD[i % len(ODD)] if i % 3 else f"T{i} " + "x" * rng.randrange(50), "en" if i % 4 else rng.choice(["de", None, "ñ", "fr"]), None if i % 5 == 0 else f"s{i % 3}", None if i % 7 == 0 else i) for i in range(n)]
    rng.shuffle(rows)
    return rows + rows[: min(n, 3)] + [(None, "no id", "en", "s", 1), (None, None, None, None, None)] * (n > 3)


def rise(nodes, paths):
    """The top of ``nodes``; ``paths`` gets, of each node, the (siblings before, after) of every level."""
    of = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_of = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for leaf in of[a + k]:
                    paths[leaf].append((run[:k], run[k + 1 :]))
            up.append(H("".join(run)))
            up_of.append([x for k in range(len(run)) for x in of[a + k]])
        nodes, of = up, up_of
    return nodes[0]


def manifest_by_loops(rows):
    def leaf(r, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    langs, sub, low, every = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())), [], [], []
    for lang in langs:
        mine = sorted((((r[0] is not None, r[0] or 0), leaf(r, r[1]), r) for r in rows if r[2] == lang), key=lambda x: x[:2])
        paths = [[] for _ in mine]
        sub.append(rise([m[1] for m in mine], paths))
        low.append(paths)
        every.append(mine)
    high = [[] for _ in langs]
    root = rise(sub, high)
    out = []
    for s, paths, mine, top in zip(sub, low, every, high, strict=True):
        for (_, h, r), path in zip(mine, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf(r, lower(r[1])) if tampered else h
            for before, after in path + top:
                fold = H("".join([*before, fold, *after]))
            out.append((r[0], h, s, root, H("".join(x for b, a in path + top for x in b + a)), fold, fold == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 9, 150])
def test_manifest_against_loops(spark, tmp_path, n):
    rows = odd_rows(n)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit(1), "path": F.lit("x"), "tree": F.lit(2), "position": F.lit(3)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.op11_merkle_paths(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(manifest_by_loops(rows), key=key)
    if n == 150:
        assert {r[6] for r in got} == {True, False}


def test_manifest_of_nothing_and_with_many_langs(spark, monkeypatch):
    none = spark.createDataFrame([], DOCS)
    assert merkle_paths.proofs(merkle_paths.manifest(none)).count() == 0
    monkeypatch.setattr(merkle_paths, "MANY", 0)
    rows = [(i, f"t{i}", f"l{i % 70}", "s", 1) for i in range(200)]
    out = merkle_paths.proofs(merkle_paths.manifest(spark.createDataFrame(rows, DOCS))).collect()
    assert len(out) == 200 and all(r["folded_root"] == r["root"] for r in out) and len({r["root"] for r in out}) == 1
    assert {len(r["path"]) for r in out} == {4} and all(len(s) == len(p) - 64 for r in out for s, p in zip(r["siblings"], r["path"], strict=True))


def test_places_over_a_whole_table(spark):
    rows = spark.range(5000).select(((F.col("id") * 37) % 1000).alias("a"), F.col("id").alias("b")).repartition(5)
    got = numbered(rows, [F.col("a").desc(), F.col("b").asc()], "places").collect()
    want = sorted(((r["a"], r["b"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["position"])] == want and {r["position"] for r in got} == set(range(5000))
    assert numbered(rows.limit(0), [F.col("a")], "places").count() == 0


def search_by_loops(docs, items, k):
    cut = lambda t: re.findall(block_max.TERMS, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(cut(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,shard,batch", [(16, 2_000_000, 1_000_000), (3, 200, 25)])
def test_search_against_loops(spark, monkeypatch, block, shard, batch):
    rng = random.Random(5)
    words = ["Alpha", "beta", "gam-ma", "d3lta", "épée", "ÉPÉE", "日本", "x" * 30, "ze", "the", "the", "the", "\x00null"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(30)] + [docs[3]] * 3 + [(None, docs[7][1]), (None, None), (300, ""), (301, None), (302, "--- ???")]
    rng.shuffle(docs)
    items = [(i, text(n)) for i, n in enumerate([1, 2, 8, 40])] + [(10, docs[0][1]), (11, None), (12, ""), (13, "unheard of words"), (None, "beta ze"), (14, "the the the"), (14, "beta"), (14, "beta")]
    monkeypatch.setattr(block_max, "SHARD", shard)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"terms": F.lit(1), "n": F.lit("x"), "block": F.lit(0)}).repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(1))
    index = block_max.build(table, block)
    got = sorted((tuple(r) for r in block_max.search(index, queries, 6, batch).collect()), key=str)
    assert got == search_by_loops(docs, items, 6)
    assert block_max.search(index, queries.limit(0)).count() == 0
    assert block_max.search(block_max.build(table.limit(0)), queries).count() == 0


def test_blocks_are_left_out_when_their_bound_is_too_low():
    rng = np.random.default_rng(6)
    docs, vocabulary = 4000, 50
    term = np.sort(rng.integers(1, vocabulary, (docs, 6)), axis=1)
    rare = rng.choice(docs, 40, replace=False)
    term[rare, 0] = 0
    impact = rng.integers(1, 100, (docs, 6))
    shard = block_max.Shard(np.arange(docs) // 16, np.arange(docs), np.zeros(docs, bool), np.full(docs, 6), term.ravel(), impact.ravel(), vocabulary)
    best, dense = block_max.Best(10), np.zeros(vocabulary, np.int64)
    shard.search(np.array([0, 3]), np.array([1000, 1]), best, dense)
    score = np.where(term == 0, impact * 1000, 0).sum(1) + np.where(term == 3, impact, 0).sum(1)
    want = np.lexsort((np.arange(docs), -score))[:10]
    assert best.ids.tolist() == want.tolist() and best.scores.tolist() == score[want].tolist()
    assert shard.scored < shard.blocks / 4 and not dense.any()


def fingerprint_by_loops(text):
    parts = [p for p in (text or "").split("\n") if p]
    n, equal, wide = 0, [0] * multiset_hash.EQUAL, [0] * multiset_hash.WIDE
    for p in parts:
        g = H("0" + p) + H("1" + p)
        equal = [(e + int(g[8 * i : 8 * i + 8], 16)) % 2**32 for i, e in enumerate(equal)]
        w = p.split(" ")
        for s in [p] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]:
            n += 1
            m = hashlib.md5(s.encode()).hexdigest()
            for k in range(2):
                bits = int(m[16 * k : 16 * k + 16], 16)
                for j in range(64):
                    wide[64 * k + j] += bits >> j & 1
    return [n, *equal, *wide]


def near(a, b):
    x, y = ([2 * c - v[0] for c in v[1 + multiset_hash.EQUAL :]] for v in (a, b))
    both = sum(p * p for p in x) + sum(p * p for p in y)
    return 1.0 if not both else max(0.0, 2 * sum(p * q for p, q in zip(x, y, strict=True)) / both)


def test_fingerprints_against_loops(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    texts = ODD + ["\n".join(" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "other text of one id"), (None, "no id"), (None, None)]
    monkeypatch.setattr(multiset_hash, "ROWS", 1)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"uid": F.lit(1), "bin": F.lit("x"), "n": F.lit(0)}).repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op13_multiset_hash(spark, str(tmp_path)).collect()
    th = {r["text"]: r["th"] for r in table.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), th[r[1]], r[1] or ""))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(fingerprint_by_loops, (t, edited, after))
        digits = lambda v: "".join(f"{x:08x}" for x in v)
        want.append((i, len(t), H(edited), digits(a), digits(b), round(near(a, b), 12), round(near(a, c), 12)))
    mine = [(*tuple(r)[:5], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    few = registry.op13_multiset_hash
    table.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert few(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(5, "a b c d")], "doc_id long, text string").write.parquet(str(tmp_path / "one/documents.parquet"))
    alone = few(spark, str(tmp_path / "one")).first()
    assert alone["near_next"] == 1 and alone["edited_sha256"] == H("a b " + "a b")


def test_paragraphs_come_and_go(spark):
    rows = spark.createDataFrame([("a", "one two three four\nfive six\nseven"), ("b", "seven\none two three four\n\nfive six"), ("c", "one two three four\nseven"), ("d", "five six"), ("e", "")], "k string, text string")
    v = multiset_hash.vectors(rows, ["k"]).groupBy().pivot("k", list("abcde")).agg(F.first("vector"))
    r = v.select("*", multiset_hash.plus("c", "d").alias("cd"), multiset_hash.minus("a", "d").alias("ad"), multiset_hash.likeness("a", "b").alias("ab"), multiset_hash.likeness("e", "e").alias("ee"), multiset_hash.likeness("a", "e").alias("ae")).first()
    assert r["a"] == r["b"] == r["cd"] and r["ad"] == r["c"] and r["a"] != r["c"]
    assert (r["ab"], r["ee"], r["ae"]) == (1.0, 1.0, 0.0) and not any(r["e"])


def test_ids_that_hold_many_rows_are_divided(spark):
    docs = [(7, f"text {i}") for i in range(300)] + [(i, f"t{i}") for i in range(20)] + [(None, f"n{i}") for i in range(40)]
    rows = multiset_hash.successors(spark.createDataFrame(docs, "doc_id long, text string"))
    got = rows.collect()
    after = {r["uid"]: r["next_uid"] for r in got}
    at, seen = next(iter(after)), []
    while at not in seen[:1]:
        seen.append(at)
        at = after[at]
    assert len(seen) == len(docs) == len(after)  # one ring of all rows
    ids = {r["uid"]: r["doc_id"] for r in got}
    falls = sum((ids[u] is not None, ids[u] or 0) < (ids[after[u]] is not None, ids[after[u]] or 0) for u in seen)
    assert falls == 1  # descending but for the way back to the first
