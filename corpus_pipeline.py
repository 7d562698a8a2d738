"""A training-corpus pipeline: classify, cut repeated lines, drop near-duplicates, mix, tokenise.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the
documents that go on, with their columns, and the last one the tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm import byte_cnn, line_winnow, pfair_mix, piece_bpe, simhash_bk
from spanforge.llm.common import materialize, table
from spanforge.llm.registry import labelled

#: near-duplicates have a Jaccard similarity of LEAST or more between their sets of five-word shingles
SHINGLE, LEAST = 5, 0.8


OWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def packed(stage: Stage) -> Stage:
    """``stage`` on documents whose further columns travel as one struct, so that none of their names can clash."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        more = [c for c in names if c not in OWN]
        held = [F.struct(*[F.col(f"`{c}`") for c in more]).alias("carried")] if more else []
        out = stage(spark, docs.select(*[c for c in names if c in OWN], *held), sf_dir)
        return out.select(*[F.col(f"carried.`{c}`").alias(c) if c in more else F.col(c) for c in names])

    return run


@packed
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality probability is 0.3 or more."""
    model = byte_cnn.train(labelled(spark, sf_dir, "quality", byte_cnn.MAX_TRAIN_DOCS))
    return byte_cnn.score(docs, model, docs.columns, "quality").filter(F.col("quality") >= 0.3).select(*docs.columns)


@packed
def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of runs of 50 words or more."""
    cut = line_winnow.dedup_lines(docs, native=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@packed
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, then text hash.

    Rows of one doc_id with different texts are different documents; rows that agree in both
    are one. Documents without an id come last, and are told apart by their texts.
    """
    found = simhash_bk.similar_documents(docs, SHINGLE, LEAST)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("r")
    key = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("")).alias("key")
    kept = found.groupBy("root").agg(first).select(key(F.col("r.doc_id")), F.col("r.th").alias("th")).distinct()
    rows = docs.select(key(F.col("doc_id")), F.xxhash64("text").alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = rows.join(kept, ["key", "th"], "left_semi").groupBy("key", "th").agg(F.first("row").alias("row"))
    return one.select(*[F.col(f"row.`{c}`") for c in docs.columns])


@packed
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule."""
    return pfair_mix.schedule(docs).orderBy("position").select(*docs.columns)


def written_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and position: the number of the row in the order in which its files were written.

    Rereading deals files to tasks in another order, so the place comes from the number of
    the file and of the row in it. Only one row a file is ordered in one task.
    """
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "text", place["file_path"].alias("file"), place["row_index"].alias("row"))
        rows.schema  # noqa: B018  (frames that were not read from files have no such columns)
    except AnalysisException:
        rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("id"))
        rows = rows.select("doc_id", "text", F.shiftright("id", 33).cast("string").alias("file"), F.col("id").bitwiseAND((1 << 33) - 1).alias("row"))
    part = F.coalesce(F.regexp_extract("file", r"(?:^|/part-)(\d+)[^/]*$", 1).try_cast("long"), F.lit(0))
    sizes = rows.groupBy("file").agg((F.max("row") + 1).alias("n")).withColumn("part", part)
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "file").select("doc_id", "text", (F.col("start") + F.col("row")).alias("position"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, lossless and position (place in the mixed order, from 0) of all documents."""
    return piece_bpe.encode_documents(written_order(docs), piece_bpe.load(), carry=("position",))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", cut_lines),
    ("near-duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("tokens", tokenize),
]

#: the classifier and the tokeniser cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
