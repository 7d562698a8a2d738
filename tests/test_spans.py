"""Span operators on small cases with known results."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.functions import text as tx
from spanforge.operators import calibration as cal
from spanforge.operators import etl, runs
from spanforge.operators import scoring as sc
from spanforge.operators import spans as sp
from spanforge.sources import records

SPAN = "doc_id long, label string, start int, end int"


def spans(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], SPAN)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,start,end,want",
    [("Anna Karimova yozdi", 0, 9, (0, 13)), ("Parijda qor", 0, 5, (0, 7)), ("o‘zbek gap", 2, 3, (0, 6)), ("Тошкентда бўлди", 0, 7, (0, 9)), ("ab\ncd", 3, 4, (3, 5))],
)
def test_word_edges(spark, text, start, end, want):
    assert tuple(one(spark, text, lambda t: tx.expand_to_word_edges(t, F.lit(start), F.lit(end)))) == want


@pytest.mark.parametrize("text,end,want", [("Tokyoda bo'ldi", 5, (7, "da", "extended")), ("Ali'ning uyi", 3, (8, "'ning", "extended")), ("Ali uyi", 3, (3, "", "space")), ("Ali", 3, (3, "", "eos")), ("J.ga", 2, (2, "", "punct")), ("Тошкентдан", 7, (10, "дан", "extended")), ("Alidagilar", 3, (3, "", "none"))])
def test_suffixes(spark, text, end, want):
    assert tuple(one(spark, text, lambda t: tx.rewrite_span_end(t, F.lit(0), F.lit(end)))) == want


def test_suffix_after_word_snap_changes_nothing(spark):
    text = "Toshkentdagi O‘zbekistonning do'stlari Москвага"
    grown = [one(spark, text, lambda t, i=i: tx.expand_to_word_edges(t, F.lit(i), F.lit(i + 2))) for i in range(0, 40, 5)]
    for g in grown:
        assert one(spark, text, lambda t, g=g: tx.rewrite_span_end(t, F.lit(g["start"]), F.lit(g["end"])))["end"] == g["end"]


def test_normal_form_and_scripts(spark):
    assert one(spark, "  Oʻzbek\n Straße ", tx.normalize_text) == "o'zbek strasse"
    assert [one(spark, t, tx.script_of) for t in ("abc", "абв", "aб", "123")] == ["latin", "cyrillic", "mixed", "other"]
    assert one(spark, "Ali va Oʻali ali", lambda t: tx.locate_mention(t, F.lit("O'ali")))["tier"] == "apostrophe"
    assert one(spark, "aXa Xa", lambda t: tx.word_starts(t, F.lit("Xa"))) == [4]


@pytest.mark.parametrize("needle", ["ab", "a a", "a", ". .", "x.", "\\E", "(", "😀a", "о"])
def test_word_starts_against_brute_force(spark, needle):
    texts = ["", None, "ab", "ab ab abab xab ab", "a a a a", ". . . .", "x.x.", r"\E\E a\E", "((a(", "😀a😀a é😀a", "о оо 1о", "ab " * 2000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.word_starts(F.col("t"), F.lit(needle)).alias("x")).collect()
    for r in rows:
        t = texts[r["i"]] or ""
        assert r["x"] == [k for k in range(len(t)) if t.startswith(needle, k) and not (k and t[k - 1].isalpha())], t[:20]


def test_greedy_selection(spark):
    got = rows(sp.select_flat(spans(spark, ("ORG", 0, 5), ("NAME", 3, 9), ("GEO", 0, 5), ("GEO", 9, 10), ("ORG", 4, 4))))
    assert got == [(1, "GEO", 9, 10), (1, "NAME", 3, 9)]
    tie = spans(spark, ("ORG", 0, 5), ("NAME", 0, 5))
    assert rows(sp.select_flat(tie)) == [(1, "ORG", 0, 5)] and rows(sp.select_flat(tie, sp.FLAT_PRIORITY)) == [(1, "NAME", 0, 5)]


def buckets(spark, gold, pred):
    return {r["bucket"]: r["n"] for r in sc.error_buckets(spans(spark, *gold), spans(spark, *pred)).collect()}


def test_error_profiles(spark):
    gold = [("NAME", 0, 4), ("GEO", 6, 9)]
    assert buckets(spark, gold, gold)["exact_match"] == 2
    swapped = [("GEO", 0, 4), ("NAME", 6, 9)]
    assert buckets(spark, gold, swapped)["type_mismatch"] == 2
    row = sc.error_analysis(spans(spark, *gold), spans(spark, *swapped)).first()
    assert row["reading"] == "type_confusion" and row["boundary_f1"] == 1
    assert buckets(spark, [("GEO", 0, 10)], [("GEO", 0, 8)])["partial_same_type"] == 1
    got = buckets(spark, [("ORG", 0, 3), ("ORG", 5, 8)], [("GEO", 20, 22)])
    assert (got["missed"], got["spurious"]) == (2, 1)
    assert rows(sc.offset_pairs(spans(spark, ("GEO", 0, 10)), spans(spark, ("GEO", 0, 8)))) == [(1, "GEO", 0, -2)]


def test_metrics_and_modes(spark):
    gold = spans(spark, ("ORG", 0, 2), ("GEO", 3, 5))
    got = {r["scope"]: r for r in sc.exact_metrics(gold, gold).collect()}
    assert got["micro"]["f1"] == 1 and got["NAME"]["f1"] == 0 and got["macro"]["f1"] == pytest.approx(2 / 3)
    v = spark.createDataFrame([(2,), (2,), (0,), (0,)], "v int").withColumn("k", F.lit(1))
    assert sp.mode_of(v, ["k"], "v").first()["mode"] == 0


def test_bio(spark):
    toks = spark.createDataFrame([(1, i, *t) for i, t in enumerate([(0, 2, "B-ORG"), (2, 5, "I-ORG"), (6, 8, "I-GEO"), (9, 10, "O"), (11, 12, "I-GEO")])], "doc_id long, ord int, start int, end int, tag string")
    assert rows(sp.decode_bio(toks)) == [(1, "GEO", 6, 8), (1, "GEO", 11, 12), (1, "ORG", 0, 5)]
    plain = toks.select("doc_id", "ord", "start", "end")
    assert [r[-1] for r in rows(sp.align_bio(plain, spans(spark, ("NAME", 0, 5))))] == ["B-NAME", "I-NAME", "O", "O", "O"]


def test_calibration(spark):
    z = spark.createDataFrame([(1, 0, k, 0.0) for k in range(3)], "id long, gold int, k int, z double")
    assert cal.predicted(cal.probabilities(z, ["id"]), ["id"]).agg(cal.nll(F.col("p_gold"))).first()[0] == pytest.approx(math.log(3))
    conf = spark.createDataFrame([(0.8, i < 4) for i in range(5)], "conf double, ok boolean")
    got = cal.binary(conf, "conf", "ok").first()
    assert got["ece"] == pytest.approx(0, abs=1e-9) and got["brier"] == pytest.approx(0.16)
    empty = cal.binary(conf.limit(0), "conf", "ok").first()
    assert (empty["n"], empty["ece"], empty["brier"]) == (0, 0, 0)
    assert scores.max_positions(512, 512, 1, "roberta") == 510


def test_bands_and_runs(spark):
    f = spark.createDataFrame([(x,) for x in (0.5, 0.7, 1.0, -0.1)], "f double")
    assert [r[0] for r in f.select(scores.band(F.col("f"))).collect()] == ["baseline", "competitive", "excellent", "broken"]
    reg = spark.createDataFrame([("a", 0.9, "2024-01-01T00:00:00Z"), ("b", 0.5, "2024-02-01T00:00:00Z"), ("c", 0.1, "soon")], "run_id string, f1 double, created_at string")
    assert runs.latest(reg).first()["run_id"] == "b" and runs.leaderboard(reg).first()["run_id"] == "a"


def test_sources(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps({"hash": "x", "text": "Ali", "entities": [{"label": "NAME", "start": 0, "end": 3}]}) + "\n")
    assert rows(records.spans_of(records.read_records_strict(spark, str(good)))) == [("x", "NAME", 0, 3)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text("{not\n\n" + good.read_text() * 2)
    with pytest.raises(ValueError, match="bad json"):
        records.read_records_strict(spark, str(bad))
    reg = tmp_path / "runs"
    reg.mkdir()
    (reg / "a.json").write_text("{not-json")
    (reg / "b.json").write_text("{}")
    (reg / "c.json").write_text(json.dumps({"run_id": "c", "metrics": {"micro": {"f1": 0.5}}}))
    assert [r["run_id"] for r in records.read_runs(spark, str(reg)).collect()] == ["c"]


def test_sources_of_spans(spark):
    docs = spark.createDataFrame([(1, "Ali va Toshkent, ali", {"PER": ["Ali", " nan "], "LOC": ["Toshkent"], "X": ["va"]})], "doc_id long, text string, ner map<string, array<string>>")
    assert rows(etl.mention_spans(docs)) == [(1, "GEO", 7, 15), (1, "NAME", 0, 3)]
    toks = spark.createDataFrame([(1, 0, "Ali", "B-PER"), (1, 1, "Valiev", "I-PER"), (1, 2, ",", "O"), (1, 3, "BMT", "B-ORG")], "doc_id long, ord int, token string, tag string")
    assert rows(etl.token_source(toks)) == [(1, "NAME", 0, 10), (1, "ORG", 12, 15)]
    gold = spark.createDataFrame([("g",)], "hash string")
    extra = spark.createDataFrame([("g",), ("a",), ("b",)], "hash string")
    assert tuple(etl.mix(gold, extra, "hash", 1, 42)[1].first()) == (1, 1, 2, 1)
    f = etl.folds(spark.range(50).withColumnRenamed("id", "k"), "k", 5, 1).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in f) == [10] * 5
