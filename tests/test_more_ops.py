"""Sinks, heavy hitters, pieces, packs in buckets and small operators against plain loops."""

from __future__ import annotations

import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.functions import text as tx
from spanforge.operators import calibration as cal
from spanforge.operators import decode as dc
from spanforge.operators import profile as pf
from spanforge.operators import runs as rn
from spanforge.operators import spans as sp
from spanforge.operators import subword as sw
from spanforge.sources import records, text_sink

SPAN = "doc_id long, label string, start int, end int"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# sinks


def test_lines_of_any_number_keep_their_order(spark, tmp_path):
    rows = spark.range(20000).select(((F.col("id") * 7919) % 20000).alias("k"), F.concat(F.lit("line "), F.col("id")).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text_sink.write_lines(rows, ["k"], str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    want = [f"line {i}" for i in sorted(range(20000), key=lambda i: i * 7919 % 20000)]
    assert list(text_sink.read_lines(spark, str(tmp_path / "out"))) == want


def test_report_holds_all_rows(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("n"), F.concat(F.lit("a|b\n"), F.col("id")).alias("name"), (F.col("id") / 7).alias("x"), F.lit(None).cast("int").alias("none"))
    text_sink.write_report([("First", rows, ["n"]), ("Nothing", rows.limit(0), ["name"])], str(tmp_path / "report"))
    lines = list(text_sink.read_lines(spark, str(tmp_path / "report/0000")))
    assert lines[:4] == ["## First", "", "| n | name | x | none |", "| --- | --- | --- | --- |"] and len(lines) == 304
    assert lines[4 + 250] == "| 250 | a\\|b 250 | 35.7143 |  |"
    assert list(text_sink.read_lines(spark, str(tmp_path / "report/0001")))[-1].startswith("| ---")
    assert pf.markdown(rows, "T", limit=5).splitlines()[-1] == "(more than 5 rows)" and "more than" not in pf.markdown(rows.limit(5), "T", limit=5)


def test_exposition_as_an_ordered_text(spark, tmp_path):
    samples = [("ner_eval_f1", f"r{i % 40:02d}", '{x="%d"}' % (i // 40), float(i)) for i in range(400)] + [("ner_eval_latest", "r01", "{}", 1.0), ("unknown", "r", "{}", 0.0)]
    rows = spark.createDataFrame(samples, "metric string, run_id string, labels string, value double")
    rn.write_exposition(rows, str(tmp_path / "prom"))
    lines = list(text_sink.read_lines(spark, str(tmp_path / "prom")))
    want = ["# HELP ner_eval_f1 Exact-span F1", "# TYPE ner_eval_f1 gauge", *[f"ner_eval_f1{x} {v}" for _, x, v in sorted((r, x, v) for m, r, x, v in samples if m == "ner_eval_f1")]]
    assert lines[: len(want)] == want and lines[-1] == "ner_eval_latest{} 1.0" and len(lines) == len(want) + 3
    assert rn.exposition_text(rows) == "\n".join(lines) + "\n"
    assert "collect_list" not in executed(rn.exposition_lines(rows)[0])


def test_records_go_out_and_come_back(spark, tmp_path):
    rows = [("a", "Ali", [("NAME", 0, 3)]), ("b", "", [])]
    records.write_records(spark.createDataFrame(rows, records.RECORD), str(tmp_path / "r"))
    back = records.read_records_strict(spark, str(tmp_path / "r"))
    assert sorted((r["hash"], r["text"], [tuple(e) for e in r["entities"]]) for r in back.collect()) == rows
    err = spark.createDataFrame([(None, "t"), ("", "t"), ("h", None), ("h", "t")], "h string, t string").select(pf.record_error(F.col("h"), F.col("t")).alias("e")).collect()
    assert [r["e"] for r in err] == ["hash", "hash", "text", None]


# registry


def test_ranks_bands_and_sort_keys(spark):
    rng = random.Random(1)
    runs = [(f"r{i:03d}", rng.choice([0.0, 0.1, 0.5, 0.61, 0.8, 1.0, rng.random()]), f"m{i % 3}") for i in range(200)]
    df = spark.createDataFrame(runs, "run_id string, f1 double, model string")
    got = [(r["rank"], r["run_id"]) for r in rn.leaderboard(df).orderBy("rank").collect()]
    assert got == [(k + 1, r[0]) for k, r in enumerate(sorted(runs, key=lambda r: (-r[1], r[0])))]
    bands = {r["band"]: (r["runs"], r["best"]) for r in rn.band_counts(df).collect()}
    for name, low, high in scores.BANDS:
        mine = [r[1] for r in runs if low <= r[1] < high]
        assert bands[name] == (len(mine), max(mine, default=None))
    assert [r["run_id"] for r in rn.ranked(df, "model", descending=False).limit(2).collect()] == ["r000", "r003"]
    with pytest.raises(ValueError):
        rn.ranked(df, "loss")


# profiles


@pytest.mark.parametrize("buckets,fullest", [(1 << 16, 1024), (16, 2), (512, 3)])
def test_heavy_hitters_are_exact(spark, monkeypatch, buckets, fullest):
    monkeypatch.setattr(pf, "BUCKETS", buckets)
    monkeypatch.setattr(pf, "FULLEST", fullest)
    rng = random.Random(2)
    names = [(i, rng.choice(["ORG", "NAME"]), f"w{int(rng.paretovariate(0.7)) % 400}") for i in range(3000)]
    df = spark.createDataFrame(names, "doc_id long, label string, surface string")
    n = Counter((x, s) for _, x, s in names)
    got = {(r["label"], r["rank"]): (r["surface"], r["n"]) for r in pf.top_per_label(df, 10).collect()}
    for label in ("ORG", "NAME"):
        want = sorted(((-c, s) for (x, s), c in n.items() if x == label))[:10]
        assert [got[label, k + 1] for k in range(10)] == [(s, -c) for c, s in want]
    both = {s for (x, s) in n if ("ORG", s) in n and ("NAME", s) in n}
    total = Counter(s for _, _, s in names)
    want = sorted(((total[s], len(s), s) for s in both), key=lambda r: (-r[0], -r[1], r[2]))[:12]
    assert [(r["total"], len(r["surface"]), r["surface"]) for r in pf.ambiguous(df, 12).collect()] == want
    assert pf.top_per_label(df.limit(0)).count() == 0 and pf.ambiguous(df.filter("label = 'ORG'")).count() == 0


def test_counters_and_surfaces(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",)], "k string")
    assert [tuple(r) for r in pf.counter(df, "k").collect()] == [("a", 2), ("b", 2), ("c", 1)] and pf.counter(df, "k", 1).count() == 1
    docs = spark.createDataFrame([(1, "Ali keldi")], "doc_id long, text string")
    assert dc.with_surface(spark.createDataFrame([(1, "NAME", 0, 3)], SPAN), docs).first()["surface"] == "Ali"
    names = spark.createDataFrame([("Microsoft Office",), ("apple",), ("office",)], "s string").select(tx.starts_with_any(F.col("s"), ["MICRO", "Apple"]).alias("x")).collect()
    assert [r["x"] for r in names] == [True, True, False]


def test_a_probe_agrees_with_plain_regression(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 3)) + y[:, None] * np.array([1.5, -1.0, 0.0])
    df = spark.createDataFrame([(int(c), [float(v) for v in row]) for c, row in zip(y, x, strict=True)], "label long, features array<double>")
    w, b = np.zeros(3), 0.0
    weight = np.where(y == 1, 300 / (2 * (y == 1).sum()), 300 / (2 * (y == 0).sum()))
    for _ in range(4000):
        g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= 0.01 * x.T @ g / 3
        b -= 0.01 * g.sum() / 3
    out = pf.linear_probe(df, df).select("features", "pred").collect()
    mine = {tuple(row): int(v > 0) for row, v in zip(x.tolist(), x @ w + b, strict=True)}
    assert np.mean([mine[tuple(r["features"])] == r["pred"] for r in out]) > 0.99
    score = pf.probe_scores(pf.linear_probe(df, df)).first()
    assert score["n"] == 300 and score["accuracy"] > 0.75 and score["majority"] == pytest.approx(max(y.mean(), 1 - y.mean()))
    assert pf.linear_probe(df.filter("label = 1"), df).select("pred").distinct().collect()[0][0] == 1


# scores


def test_scores_against_plain_arithmetic(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("a", 4.0), ("b", 7.0)], "k string, v double")
    mean, std = scores.mean_std(F.col("v"))
    got = {r["k"]: (r["m"], r["s"]) for r in rows.groupBy("k").agg(mean.alias("m"), std.alias("s")).collect()}
    assert got["a"] == (2.5, pytest.approx(statistics.stdev([1, 2.5, 4]))) and got["b"] == (7.0, 0.0)
    one = spark.range(1).select(scores.wallclock_hours(F.lit(1001), F.lit(8), F.lit(2.0)).alias("h")).first()["h"]
    assert one == pytest.approx(math.ceil(1001 / 8) * 3 / 2 * 1.15 / 3600)
    z = [(1, w, 0, 2, k, random.Random(w * 9 + k).random()) for w in range(3) for k in range(4)] + [(1, 0, 3, 3, 0, 9.0)]
    df = spark.createDataFrame(z, "doc_id long, window long, start int, end int, k int, z double")
    got = {r["k"]: r["p"] for r in cal.merged_probabilities(df).collect()}
    for k in range(4):
        ps = []
        for w in range(3):
            e = {kk: math.exp(v) for _, ww, s, t, kk, v in z if ww == w and s < t}
            ps.append(e[k] / sum(e.values()))
        assert got[k] == pytest.approx(sum(ps) / 3)
    gold = spark.createDataFrame([(-100,), (0,), (3,)], "gold int")
    assert cal.gold_tokens(gold).count() == 2
    assert cal.slim(spark.createDataFrame([(1, 2)], "ece int, bins int")).columns == ["ece"]


def test_the_majority_tagger_against_loops(spark):
    for tags, want in ((["O", "O", "B-ORG"], ("O", 2, 0, 0, 1)), (["B-ORG", "B-ORG", "O"], ("B-ORG", 2, 1, 2, 0)), (["I-GEO", "B-ORG", "I-GEO"], ("I-GEO", 2, 0, 1, 1)), (["I-GEO", "B-GEO", None], ("B-GEO", 1, 0, 3, 1))):
        toks = spark.createDataFrame([(1, i, i * 2, i * 2 + 1, t) for i, t in enumerate(tags)], "doc_id long, ord int, start int, end int, tag string")
        gold = spark.createDataFrame([(1, "ORG", 2, 3)], SPAN) if tags[1] == "B-ORG" else spark.createDataFrame([(1, "ORG", 4, 5)], SPAN)
        r = dc.majority_tagger(toks, gold).first()
        assert (r["tag"], r["n"], r["tp"], r["fp"], r["fn"]) == want and r["accuracy"] == pytest.approx(want[1] / sum(t is not None for t in tags))


# pieces and packs


def greedy(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        n = max((len(v) for v in vocabulary if v and word.startswith(v, at)), default=1)
        out.append((at, at + n))
        at += n
    return out


def test_pieces_against_loops(spark):
    rng = random.Random(5)
    for letters in ("ab", "aé😀b", "abcdef"):
        vocabulary = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 20))}
        texts = [" ".join("".join(rng.choice(letters + "x") for _ in range(rng.randrange(0, 15))) for _ in range(40)) for _ in range(5)] + ["", None]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sw.pieces(sp.tokens(docs), spark.createDataFrame([(v,) for v in vocabulary] + [("",)], "piece string")).orderBy("doc_id", "ord").collect()
        want, at = [], 0
        for d, t in enumerate(texts):
            at = 0
            for word in (t or "").split(" "):
                want += [(d, at + a, at + b) for a, b in greedy(word, vocabulary)]
                at += len(word) + 1
        assert [(r["doc_id"], r["start"], r["end"]) for r in got] == want
    assert sw.pieces(sp.tokens(docs.limit(0)), docs.limit(0).select(F.lit("a").alias("piece"))).count() == 0


def test_packs_in_buckets_meet_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1)) for i in range(60)], "doc_id long, text string")
    toks = sp.tokens(docs).select("doc_id", "ord", "start", "end")
    dc.save_pack(toks, "pack_a", 4)
    dc.save_records(docs, "records_a", 4)
    dc.save_records(docs.limit(10), "records_b", 4)
    join, size = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(join, "-1")
    try:
        rows = dc.load_pack(spark, "pack_a", "records_a")
        assert "Join" in executed(rows) and "Exchange" not in executed(rows)
        assert rows.count() == toks.count() == dc.load_pack(spark, "pack_a").count()
        got = [r["row"] for r in rows.orderBy("row").collect()]
        assert got == list(range(len(got)))
        with pytest.raises(ValueError):
            dc.load_pack(spark, "pack_a", "records_b")
    finally:
        spark.conf.set(join, size)
        for t in ("pack_a_documents", "pack_a_tokens", "records_a", "records_b"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_wrong_numbers_of_logits_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1, [0.0] * 7), (2, 0, 0, 1, [0.0] * 6)], "doc_id long, ord int, start int, end int, logits array<double>")
    assert dc.tagged_tokens(rows.filter("doc_id = 1")).first()["tag"] == "O"
    with pytest.raises(Exception, match="document 2: 6 numbers for 7 tags"):
        dc.tagged_tokens(rows).collect()


def test_items_of_any_length_are_found(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["one two three four five six seven", "xone two\nthree", "a b", "", None, "needle"]
    items = [(0, "two three four five six seven"), (1, "one two"), (2, "needle"), (3, "eedl"), (4, "none"), (5, "a b"), (6, "a b")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: r["docs"] for r in entry.queries()["benchmark_containment"](spark, str(tmp_path)).collect()}
    assert got == {i: n for i, x in items if (n := sum(x in (t or "") for t in texts))}
