"""Spans meet the text around them only: the same results as on the whole text, at a cost that does not grow with it."""

import random

from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import decode as dc
from spanforge.operators import spans as sp


def _texts() -> list[tuple[int, str]]:
    r = random.Random(5)
    words = ["ab", "Ali", "kitobda", "o‘q", "Toshkentlardan", "ж", "x" * 63, "y" * 64, "z" * 200, "Москвадан", "(", "», ", "q'ga", "\U0001f600", "-"]
    gaps = [" ", "  ", "\t", "\n", " " * 64, " \t" * 50, ""]
    long_ = ["".join(r.choice(words[:7] + words[9:]) + r.choice(gaps[:4]) for _ in range(400)) for _ in range(3)]
    return list(enumerate([*["".join(r.choice(words) + r.choice(gaps) for _ in range(30)) for _ in range(6)], "", "a", *long_]))


def test_functions_give_the_same_in_context_as_on_the_whole_text(spark):
    r = random.Random(6)
    texts = _texts()
    rows = set()
    for d, t in texts:
        for _ in range(60):
            s = r.randint(0, len(t) + 2)
            rows.add((d, s, s + r.choice([0, 1, 2, 5, 30, 150])))
        rows |= {(d, 0, len(t)), (d, len(t), len(t)), (d, -3, 2), (d, 5, 2)}
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    spans = spark.createDataFrame([(d, s, e) for d, s, e in rows], "doc_id int, start int, end int")

    def what(text, base):
        s, e = F.col("start") - base, F.col("end") - base
        up = lambda x: F.struct((x["start"] + base).alias("a"), (x["end"] + base).alias("b"))
        side = lambda n: F.when((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("size")), tx.neighbour_word(text, s, e, n))
        end = tx.rewrite_span_end(text, s, e)
        return [
            up(tx.expand_to_word_edges(text, s, e)), tx.slice_text(text, s, e), (end["end"] + base).alias("to"), end["reason"], end["matched"], tx.mid_token(text, s), tx.mid_token(text, e),
            F.when(side("right").isNotNull(), up(side("right"))), F.when(side("left").isNotNull(), up(side("left"))), F.when(F.col("start") >= 0, F.transform(tx.words_in(text, s, e), up)),
        ]

    whole = spans.join(docs, "doc_id").withColumn("size", F.length("text"))
    want = {tuple(x[:3]): x[3:] for x in whole.select("doc_id", "start", "end", *what(F.col("text"), F.lit(0))).collect()}
    some = sp.in_context(spans, docs).withColumn("size", F.col("n"))
    got = {tuple(x[:3]): x[3:] for x in some.select("doc_id", "start", "end", *what(F.col("ctx"), F.col("base"))).collect()}
    assert len(want) == len(rows) and got == want


def test_a_span_in_a_long_text_meets_a_few_pages(spark):
    docs = spark.createDataFrame([(1, "Ali kitobda " * 20_000)], "doc_id int, text string")
    spans = spark.range(0, 2000).select(F.lit(1).alias("doc_id"), F.lit("NAME").alias("label"), (F.col("id") * 120).alias("start"), (F.col("id") * 120 + 3).alias("end"))
    rows = sp.in_context(spans, docs)
    assert "text" not in rows.columns and rows.agg(F.max(F.length("ctx"))).first()[0] <= 6 * tx.PAGE
    assert sp.snap_words(spans, docs).count() == 2000 and dc.neighbour_words(spans, docs).count() == 3999


def test_suffix_of_a_surface_is_the_longest_that_fits(spark):
    def before(surface: str) -> str:
        import re

        low, out = surface.strip(" ").lower(), ""
        for s in sorted(tx.SUFFIXES, key=lambda x: (len(x), x)):
            if re.search(rf"^[^ ]{{2,}}(?:[^\W\d_]|['ʼʻ‘’]){s}$", low):
                out = s
        return out

    names = ["kitoblardan", "Kitobda", "da", "abda", "ab da", "o‘qlardagi", "Москвадан", "lardan", "xlarda", "xylarda", "abcning ", "ab1da", "", "kitobda\n"]
    rows = spark.createDataFrame([(n,) for n in names], "s string").select("s", tx.surface_suffix(F.col("s")).alias("x")).collect()
    assert {r["s"]: r["x"] for r in rows} == {n: before(n) for n in names}
    # one pattern, not one a suffix
    plan = spark.range(1).select(tx.surface_suffix(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract" in plan and "RLIKE" not in plan


def test_a_lexicon_made_from_the_texts_is_worked_out_once(spark):
    from spanforge.operators import etl

    docs = spark.createDataFrame([(1, "Ali va Toshkent"), (2, "Toshkentda Ali")], "doc_id int, text string")
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    names = spark.createDataFrame([("Ali", "NAME", "a"), ("Toshkent", "GEO", "b")], "surface string, label string, k string").coalesce(1).mapInArrow(seen, "surface string, label string, k string")
    found = {tuple(r) for r in etl.gazetteer_spans(docs, names).select("doc_id", "label", "start", "end").collect()}
    assert found == {(1, "NAME", 0, 3), (1, "GEO", 7, 15), (2, "GEO", 0, 8), (2, "NAME", 11, 14)}
    assert made.value == 2
