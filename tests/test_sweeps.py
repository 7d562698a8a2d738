"""Sweeps, grid joins, automata, filters and strict scans against plain loops, and what their plans must not hold."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.operators import calibration as cal
from spanforge.operators import decode as dc
from spanforge.operators import etl
from spanforge.operators import gazetteer as gz
from spanforge.operators import profile as pf
from spanforge.operators import spans as sp
from spanforge.operators import tuning as tu
from spanforge.sources import records, strict

SPAN = "doc_id long, label string, start int, end int"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def spans_of(spark, rows):
    return spark.createDataFrame(rows, SPAN)


def test_tokens_of_long_and_odd_texts(spark):
    rng = random.Random(1)
    texts = ["", None, " ", "\n\n a", "one", "😀 ü\tx y", " ".join("w" * rng.randrange(0, 9) for _ in range(3000)), "\n".join(["ab"] * 600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["ord"], r["start"], r["end"], r["surface"]) for r in sp.tokens(docs).collect())
    want = []
    for d, t in enumerate(texts):
        at = 0
        for k, p in enumerate(re.split("[ \n]", t or "")):
            if p:
                want.append((d, k, at, at + len(p), p))
            at += len(p) + 1
    assert got == sorted(want)


def test_sums_of_tokens_are_not_worked_out_for_each(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    optimized = plan(sp.tokens(docs)).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # one sum of sizes and one of stretches, both outside of the functions over tokens
    assert optimized.count("aggregate(") == 2 and "Exchange" not in plan(sp.tokens(docs))


def case(seed, flat=False):
    """Tokens that do not overlap, and spans, of a few documents."""
    rng = random.Random(seed)
    toks, spans = [], []
    for d in range(5):
        at = 0
        for k in range(60):
            size = rng.choice([0, 1, 3, 12])
            toks.append((d, k, at, at + size, rng.randrange(100) / 100))
            at += size + rng.choice([0, 1])
        p = 0
        while p < at:
            n = rng.choice([1, 2, 5, 30])
            spans.append((d, rng.choice(["ORG", "NAME", "GEO"]), p, p + n))
            p += n + rng.randrange(6) if flat else rng.randrange(1, 20)
    return toks, spans


@pytest.mark.parametrize("seed", range(3))
def test_alignment_against_loops(spark, seed):
    toks, spans = case(seed, flat=True)
    df = sp.align_bio(spark.createDataFrame([t[:4] for t in toks], "doc_id long, ord int, start int, end int"), spans_of(spark, spans))
    want = {}
    for d, k, s, e, _ in toks:
        hit = min(((y, x, lab) for dd, lab, x, y in spans if dd == d and x < e and y > s), default=None)
        want[d, k] = None if s == e else "O" if hit is None else ("B-" if s <= hit[1] < e else "I-") + hit[2]
    assert {(r["doc_id"], r["ord"]): r["tag"] for r in df.collect()} == want
    assert "Join" not in plan(df)


@pytest.mark.parametrize("seed", range(3))
def test_confidence_and_mass_against_loops(spark, seed):
    toks, spans = case(seed)
    t = spark.createDataFrame([(d, s, e, c) for d, _, s, e, c in toks], "doc_id long, start int, end int, conf double")
    mean = lambda x: sum(x) / len(x) if x else 0
    inside = {(d, lab, s, e): mean([c for dd, _, x, y, c in toks if dd == d and x < y and x >= s and y <= e]) for d, lab, s, e in spans}
    touching = {(d, lab, s, e): mean([c for dd, _, x, y, c in toks if dd == d and x < y and x < e and y > s]) for d, lab, s, e in spans}
    conf = cal.entity_confidence(spans_of(spark, spans), t)
    mass = cal.entity_mass(spans_of(spark, spans), t.withColumnRenamed("conf", "mass"))
    for df, name, want in ((conf, "conf", inside), (mass, "mass", touching)):
        got = {(r["doc_id"], r["label"], r["start"], r["end"]): r[name] for r in df.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        assert "Join" not in plan(df)


def test_pairs_on_the_grid(spark):
    _, spans = case(7)
    spans += [(9, "ORG", 4, 4), (9, "ORG", 2, 9), (9, "GEO", 2, 9)]
    docs = spark.createDataFrame([(d, "x" * 2000) for d in {s[0] for s in spans}], "doc_id long, text string")
    got = pf.integrity(spans_of(spark, spans), docs).first()
    key = lambda s: (s[2], s[3], s[1])
    pairs = [(a, b) for a in spans for b in spans if a[0] == b[0] and key(a) < key(b) and b[2] < a[3] and a[2] < b[3]]
    nested = [1 for a, b in pairs if (a[2] <= b[2] and b[3] <= a[3]) or (b[2] <= a[2] and a[3] <= b[3])]
    assert (got["overlap"], got["nested"], got["n"]) == (len(pairs), len(nested), len(spans))


def test_a_long_document_meets_only_near_spans(spark):
    n = 100_000
    spans = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("ORG").alias("label"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 12).cast("int").alias("end"))
    assert sp.overlapping_pairs(spans, spans).count() == n + 2 * (n - 1)
    held = spans.select(sp.cells(F.col("start"), F.col("end")).alias("cell")).groupBy("cell").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert held["most"] <= 9 and held["all"] < 1.3 * n


def test_automaton_against_loops(spark, monkeypatch):
    rng = random.Random(2)
    for _ in range(60):
        monkeypatch.setattr(gz, "STRETCH", rng.choice([1, 3, 7, 1024]))
        letters = rng.choice(["ab", "abc", "aé😀b"])
        words = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))})
        texts = ["".join(rng.choice(letters + "x ") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 6))]
        t, w, at = gz.Automaton(words).find(texts)
        assert sorted(zip(t.tolist(), [words[i] for i in w], at.tolist(), strict=True)) == sorted((i, x, k) for i, y in enumerate(texts) for x in words for k in range(len(y)) if y.startswith(x, k))


def test_lexicon_in_parts(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(80)})
    texts = ["".join(rng.choice("abcde ") for _ in range(200)) for _ in range(6)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = spark.createDataFrame([(w,) for w in words] + [("",), ("ab",)], "surface string")
    want = sorted((d, w, k, k + len(w)) for d, t in enumerate(texts) for w in {*words, "ab"} for k in range(len(t or "")) if t.startswith(w, k))
    for entries in (gz.ENTRIES, 300):
        assert sorted(map(tuple, gz.lexicon_hits(docs, lexicon, entries).collect())) == want
    assert gz.lexicon_hits(docs, lexicon.limit(0)).count() == 0


def leak_case(spark):
    rng = random.Random(4)
    own = ["Text %d of  mine" % i for i in range(400)] + [None, ""]
    rows = [(i, f"s{rng.randrange(3)}", rng.choice(own) if i % 3 else f"TEXT {i} of\nmine") for i in range(900)]
    official = [(i, t) for i, t in enumerate(own[:150] + ["text 200 of mine"])]
    return spark.createDataFrame(rows, "doc_id long, source string, text string"), spark.createDataFrame(official, "doc_id long, text string"), rows, official


def norm(t):
    return None if t is None else " ".join(t.lower().split())


def test_leaks_against_loops(spark, tmp_path):
    df, off, rows, official = leak_case(spark)
    known = {norm(t) for _, t in official}
    kept = sorted(r[0] for r in rows if r[2] is not None and norm(r[2]) not in known)
    out = etl.drop_leaks(df, off)
    assert sorted(r["doc_id"] for r in out.collect()) == kept and out.columns == df.columns
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan(out))
    assert keys and not any(re.search(r"\b(text|norm)#|_norm", k) for k in keys)
    want, seen = {}, {}
    for d, s, t in rows:
        want.setdefault(s, [0, 0, 0, 0])[0] += 1
        if t is not None and norm(t) in known:
            want[s][1] += 1
        elif t is not None:
            seen.setdefault(norm(t), []).append((s, d))
    for group in seen.values():
        want[min(group)[0]][3] += 1
    for w in want.values():
        w[2] = w[0] - w[1] - w[3]
    got = {r["source"]: [r["docs_in"], r["official"], r["cross_source"], r["kept"]] for r in etl.conservation(df, off).collect()}
    assert got == want
    # the same counters come with the write
    counted = etl.write_kept(df, off, str(tmp_path / "kept"), sorted(want))
    assert {c["source"]: [c["docs_in"], c["official"], c["cross_source"], c["kept"]] for c in counted} == want
    back = spark.read.parquet(str(tmp_path / "kept"))
    assert back.count() == sum(w[3] for w in want.values()) and sorted(r["doc_id"] for r in back.collect()) == sorted(min(g)[1] for g in seen.values())
    assert etl.drop_leaks(df, off.limit(0)).count() == sum(r[2] is not None for r in rows)


def test_filter_lets_few_through(spark):
    known = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    bits = etl._BUCKET
    rows = spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("d")).crossJoin(etl.bloom_filter(known, bits)).withColumn("may", etl.may_hold(bits))
    got = rows.groupBy((F.col("id") < 2000).alias("in")).agg(F.avg(F.col("may").cast("double")).alias("share")).collect()
    share = {r["in"]: r["share"] for r in got}
    assert share[True] == 1 and share[False] < 0.02


def test_finished_records(spark):
    docs = spark.createDataFrame([(1, "Toshkentda bugun Ali keldi"), (2, "no spans"), (3, " Ali ")], "doc_id long, text string")
    spans = spans_of(spark, [(1, "GEO", 0, 8), (1, "ORG", 0, 4), (1, "NAME", 17, 20), (3, "NAME", 0, 4)])
    got = etl.finalized_records(spans, docs, "src").collect()
    assert [(r["doc_id"], [tuple(e) for e in r["entities"]]) for r in got] == [(1, [("GEO", 0, 10), ("NAME", 17, 20)])]
    assert re.fullmatch("sv[0-9a-f]{40}", got[0]["hash"])
    assert [tuple(e) for e in etl.canonical(spans_of(spark, [(1, "B", 5, 6), (1, "A", 5, 6), (1, "C", 0, 9)])).first()["entities"]] == [("C", 0, 9), ("A", 5, 6), ("B", 5, 6)]


def test_continuation_sweep_equals_growing_each_time(spark):
    rng = random.Random(6)
    texts, gold, pred, mass = [], [], [], []
    for d in range(12):
        words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(25)]
        at = 0
        for w in words:
            mass.append((d, at, at + len(w), *[rng.randrange(100) / 100 for _ in range(3)]))
            label = rng.choice(list(sp.PRIORITY))
            if rng.random() < 0.4:
                pred.append((d, label, at, at + len(w), rng.randrange(10) / 10))
            if rng.random() < 0.4:
                gold.append((d, label, at, at + len(w) + rng.choice([0, 0, 2])))
            at += len(w) + 1
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masses = spark.createDataFrame(mass, "doc_id long, start int, end int, mass_ORG double, mass_NAME double, mass_GEO double")
    spans = spark.createDataFrame(pred, SPAN + ", conf double")
    gates, taus = [0.0, 0.5], [0.2, 0.6, 0.9]
    got = {(r["gate"], r["direction"], r["tau"]): (r["tp"], r["fp"], r["fn"]) for r in tu.continuation_sweep(spans_of(spark, gold), spans, docs, masses, gates, taus).collect()}
    assert len(got) == len(gates) * len(taus) * 3
    truth = set(gold)
    for gate, direction, tau in [(0.0, "both", 0.2), (0.5, "right", 0.6), (0.5, "both", 0.9), (0.0, "left", 0.6)]:
        kept = spans.filter(F.col("conf") >= gate).drop("conf") if gate else spans.drop("conf")
        grown = {tuple(r) for r in dc.continue_spans(kept, docs, masses, tau, direction, snap=False).collect()}
        assert got[gate, direction, tau] == (len(grown & truth), len(grown - truth), len(truth - grown))


def lines_case():
    ok = lambda i, e=(): json.dumps({"hash": f"h{i}", "text": "Ali keldi", "entities": list(e)})
    e = lambda label, s, t: {"label": label, "start": s, "end": t}
    return ok, e


@pytest.mark.parametrize(
    "line,problem",
    [
        ("", "blank line"), ("  \t", "blank line"), ("{broken", "bad json"), ("[1]", "bad json"), ('{"hash": 5}', "no hash"), ('{"hash": ""}', "no hash"), ('{"hash": "x"}', "no text"), ('{"hash": "x", "text": 1}', "no text"),
        ('{"hash": "x", "text": "a"}', "no entities"), ('{"hash": "x", "text": "a", "entities": {}}', "no entities"), ('{"hash": "x", "text": "a", "entities": [1]}', "entity 0 is not an object"),
        ('{"hash": "x", "text": "abc", "entities": [{"label": "LOC", "start": 0, "end": 1}]}', "entity 0 has no known label"), ('{"hash": "x", "text": "abc", "entities": [{"label": "ORG", "start": 0, "end": 4}]}', "entity 0 has bad offsets"),
        ('{"hash": "x", "text": "abc", "entities": [{"label": "ORG", "start": 0, "end": 1}, {"label": "ORG", "start": true, "end": 2}]}', "entity 1 has bad offsets"), ('{"hash": "x", "text": "abc", "entities": [{"label": "ORG", "start": 1, "end": 1.5}]}', "entity 0 has bad offsets"),
        ('{"hash": "x", "text": "abc", "entities": [{"label": "ORG", "start": 0, "end": 1}, {"label": "GEO", "start": 1, "end": 2}, {"label": "ORG", "start": 0, "end": 1}]}', "entity 2 is repeated"),
        ('{"hash": "x", "text": "abc", "entities": [{"label": "ORG", "start": 1, "end": 3}, {"label": "GEO", "start": 0, "end": 2}]}', "overlapping entities"), ('{"hash": "h7", "text": "a", "entities": []}', "duplicate hash h7"),
    ],
)
def test_strict_scan_names_file_and_line(spark, tmp_path, line, problem):
    ok, e = lines_case()
    lines = [ok(i, [e("NAME", 0, 3), e("ORG", 4, 9)]) for i in range(120)]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join([*lines[:77], line, *lines[77:]]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # several blocks a file
    try:
        assert strict.located_lines(spark, str(path)).select("block").distinct().count() > 5
        with pytest.raises(ValueError, match=re.escape(f"a.jsonl:78: {problem}")):
            records.read_records_strict(spark, str(path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_strict_scan_of_good_and_empty_files(spark, tmp_path):
    ok, e = lines_case()
    (tmp_path / "good.jsonl").write_text("\n".join(ok(i, [e("NAME", 0, 3)]) for i in range(30)) + "\n\n")
    with pytest.raises(ValueError, match="good.jsonl:31: blank line"):
        records.read_records_strict(spark, str(tmp_path / "good.jsonl"))
    assert records.read_records_strict(spark, str(tmp_path / "good.jsonl"), limit=30).count() == 30
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError, match="no records"):
        records.read_records_strict(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "pred.jsonl").write_text('{"hash": "a"}\n{"hash": "b", "entities": [{"label": "?"}]}\n')
    assert records.read_records_strict(spark, str(tmp_path / "pred.jsonl"), require_entities=False).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"hash": "a", "entities": 1}\n')
    with pytest.raises(ValueError, match="bad.jsonl:1: no entities"):
        records.read_records_strict(spark, str(tmp_path / "bad.jsonl"), require_entities=False)
