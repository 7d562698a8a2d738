"""JSON-lines records with spans: strict and lenient scans, run files, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.sources import strict

ENTITY = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RECORD = T.StructType([T.StructField("hash", T.StringType()), T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(ENTITY))])
PRF = "precision double, recall double, f1 double, tp long, fp long, fn long"
RUN = f"run_id string, model string, checkpoint string, created_at string, split string, hyperparams map<string, string>, metrics struct<records: long, by_label: map<string, struct<{PRF.replace(' double', ': double').replace(' long', ': long')}>>, micro: struct<{PRF.replace(' double', ': double').replace(' long', ': long')}>, macro: struct<precision: double, recall: double, f1: double>>"


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lenient scan: blank lines are skipped, broken ones are null records in ``_corrupt_record``.

    With ``limit`` the scan stops after that many records.
    """
    schema = T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows if limit is None else rows.limit(limit)


def record_problems(spark: SparkSession, path: str) -> DataFrame:
    """problem, n: what a strict scan refuses, each line by the first rule that it breaks. No rows, no problem."""
    rows = strict.judged(strict.located_lines(spark, path))
    kind = F.when(F.col("problem").startswith("entity"), F.regexp_replace("problem", "^entity [0-9]+ ", "entity ")).otherwise(F.col("problem"))
    found = rows.groupBy(kind.alias("problem")).agg(F.count("*").alias("n"))
    twice = strict.repeated(rows).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("duplicate hash").alias("problem"), "n")
    empty = rows.agg(F.count("*").alias("c")).filter("c = 0").select(F.lit("no records").alias("problem"), F.lit(1).cast("long").alias("n"))
    return found.filter("problem is not null").unionByName(twice).unionByName(empty)


def read_records_strict(spark: SparkSession, path: str, limit: int | None = None, require_entities: bool = True) -> DataFrame:
    """Like ``read_records``, but raises ValueError with the file, the line and the rule of the first problem.

    With ``limit`` only that many lines are read and judged.
    """
    found = strict.first_problem(spark, path, require_entities, limit)
    if found:
        raise ValueError(found)
    if limit is not None:
        return spark.read.text(path).limit(limit).select(F.from_json("value", RECORD).alias("r")).select("r.*")
    return read_records(spark, path).drop("_corrupt_record")


def spans_of(records: DataFrame) -> DataFrame:
    """doc_id, label, start, end of records' entities."""
    return records.select(F.col("hash").alias("doc_id"), F.inline("entities"))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run documents (one JSON file each); broken and incomplete ones are left out."""
    rows = spark.read.schema(RUN + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter("_corrupt_record is null and run_id is not null and metrics.micro.f1 is not null").drop("_corrupt_record")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """train, dev (records), labels of a data manifest."""
    schema = "splits struct<train: struct<records: long>, dev: struct<records: long>>, schema struct<labels: array<string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("splits.train.records").alias("train"), F.col("splits.dev.records").alias("dev"), F.col("schema.labels").alias("labels"))


SPAN_SOURCE = "id string, text string, entities array<struct<label: string, start: int, end: int, text: string>>, meta struct<is_synthetic: boolean, source_tier: string, id: string>"


def read_span_source(spark: SparkSession, path: str) -> DataFrame:
    """Records of a span source with claimed texts and meta; blank lines are skipped."""
    return spark.read.schema(SPAN_SOURCE).json(path).withColumnRenamed("id", "doc_id")


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ord, token, tag of a token table (Parquet or CSV) with Sentence, TokenOrder, Token, NER_Tag."""
    rows = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return rows.select(F.col("Sentence").cast("long").alias("doc_id"), F.col("TokenOrder").cast("int").alias("ord"), F.coalesce(F.col("Token").cast("string"), F.lit("")).alias("token"), F.coalesce(F.col("NER_Tag").cast("string"), F.lit("O")).alias("tag"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """hash, entities of predictions; of repeated hashes the last in the file counts."""
    rows = spark.read.schema(RECORD).json(path).select("hash", "entities", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("k"))
    return rows.filter("hash is not null").groupBy("hash").agg(F.max_by("entities", F.struct("f", "k")).alias("entities"))


def read_tensor_index(spark: SparkSession, path: str) -> DataFrame:
    """name, shape of a checkpoint's tensors, from a JSON index; no weights are read."""
    return spark.read.schema("name string, shape array<long>").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One metrics row as one JSON document."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def union_in_order(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of several sources, with source and source_prio (their place in the list)."""
    out = None
    for k, (name, df) in enumerate(parts):
        one = df.withColumns({"source": F.lit(name), "source_prio": F.lit(k)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
