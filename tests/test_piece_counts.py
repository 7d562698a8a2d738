import re

import pytest

pytest.importorskip("pyspark")

from pyspark.sql import functions as F  # noqa: E402

from spanforge.functions import text as tx  # noqa: E402
from spanforge.operators import profile as pf  # noqa: E402
from spanforge.operators import spans as sp  # noqa: E402
from spanforge.operators import subword as sw  # noqa: E402

TEXTS = ["abab cab\nabc  aab", "", None, " \t a b​c　", "x" * 40 + " ab " * 300, "\U0001f600ab   ab"]


def test_pieces_are_counted_where_they_are_cut(spark):
    docs = spark.createDataFrame([(i, t, "l%d" % (i % 2)) for i, t in enumerate(TEXTS)] + [(None, "ab ab", "l0")], "doc_id long, text string, lang string")
    words = spark.createDataFrame([("ab",), ("abc",), ("ca",)], "piece string")
    toks = sp.tokens(docs)
    want = {r["doc_id"]: r["count"] for r in sw.pieces(toks, words).groupBy("doc_id").count().collect()}
    counted = sw.piece_counts(toks, words)
    assert {r["doc_id"]: r["n_tok"] for r in counted.collect()} == want and len(want) == 5
    rows = docs.withColumn("n_tok", F.length("text"))
    sizes = rows.select("lang", "n_tok", *pf.text_sizes())
    assert sorted(pf.tokens_per_word(rows, ["lang"]).collect()) == sorted(pf.tokens_per_word(sizes, ["lang"], sizes=("words", "chars")).collect())


def test_words_are_counted_without_a_pattern(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", tx.word_count(F.col("text")).alias("n"))
    assert all(r["n"] == (None if r["text"] is None else len(re.findall(f"[^{tx.WHITE}]+", r["text"]))) for r in rows.collect())
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
