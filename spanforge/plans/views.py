"""Annotated data derived from the tables: tokens, gold and predicted spans, logits, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.operators import scoring as sc
from spanforge.operators import spans as sp
from spanforge.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt anew if the files give fewer partitions than the session can run at once."""
    docs = table(spark, sf_dir, "documents")
    slots = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= slots else docs.repartition(slots)


def kind(n):
    return F.when(n % 3 == 0, "ORG").when(n % 3 == 1, "NAME").otherwise("GEO")


def next_label(label):
    return F.when(label == "ORG", "NAME").when(label == "NAME", "GEO").otherwise("ORG")


def annotated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted spans of ``docs``: capitalised token heads, and a fixed disturbance of them.

    Both come from one pass over the tokens and are written once, so a query cuts the texts once
    however many of its branches read spans.
    """
    toks = sp.tokens(docs).withColumn("n", F.length(F.regexp_extract("surface", r"^\p{Lu}\p{L}+", 0)))
    # as an element of an array the head is looked up once, wherever its length is used
    toks = toks.select("doc_id", "start", "end", F.length("surface").alias("size"), F.explode(F.array("n")).alias("n"))
    head = (F.col("start") + F.col("n")).cast("int")
    r = (F.col("doc_id") * 31 + F.col("start")) % 10
    found = F.col("n") > 0
    spurious = ~found & (F.col("size") >= 4) & ((F.col("doc_id") * 17 + F.col("start")) % 40 == 7)
    rows = toks.filter(found | spurious).withColumns({"r": r, "label": kind(F.col("n")), "end": F.when(found, head).otherwise(F.col("end"))})
    long_ = (F.col("end") - F.col("start")) > 2
    gold = F.struct(F.lit(True).alias("gold"), "label", "start", "end")
    pred = F.struct(
        F.lit(False).alias("gold"), F.when(~found, "GEO").when(F.col("r").isin(1, 4), next_label(F.col("label"))).otherwise(F.col("label")).alias("label"),
        F.when(found & (F.col("r") == 3) & long_, F.col("start") + 1).otherwise(F.col("start")).alias("start"),
        F.when(found & F.col("r").isin(2, 4) & long_, F.col("end") - 1).otherwise(F.col("end")).alias("end"),
    )
    each = F.when(~found, F.array(pred)).when(F.col("r") == 0, F.array(gold)).otherwise(F.array(gold, pred))
    spans = written(rows.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*"), "spans", "gold")
    return tuple(spans.filter(c).select("doc_id", "label", "start", "end") for c in (F.col("gold"), ~F.col("gold")))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    return (docs, *annotated(docs))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, gold, k, z: the components of each vector, as logits of as many classes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("gold"), F.posexplode("embedding").alias("k", "z"))


def official(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with and without a label row."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")


def runs(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    """One run per source: the exact micro metrics of its documents; ``counted`` are their counts (``document_counts``), if they are at hand."""
    docs = documents(spark, sf_dir)
    counted = sc.document_counts(*annotated(docs)) if counted is None else counted
    of = docs.select("doc_id", "source")
    rows = counted.join(of, "doc_id").groupBy("source").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    n = F.regexp_extract("source", r"\d+", 0).cast("int")
    day = F.format_string("2024-01-%02dT00:00:00Z", n % 27 + 1)
    rows = sc.with_prf(rows).withColumn("created_at", F.when(n % 7 == 3, "unknown").otherwise(day))
    return rows.select(F.col("source").alias("run_id"), F.concat(F.lit('m"'), (n % 3).cast("string")).alias("model"), F.lit("dev").alias("split"), "created_at", "precision", "recall", "f1", "tp", "fp", "fn")

