"""A registry of scored runs: ranking, latest, bands, exposition rows, upsert."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.functions import text as tx
from spanforge.sources.text_sink import write_lines

SORT_KEYS = ("f1", "precision", "recall", "created_at", "model", "split", "run_id")


def valid_ids(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("run_id").rlike(r"^[A-Za-z0-9._-]+\z"))


def ranked(runs: DataFrame, key: str = "f1", descending: bool = True) -> DataFrame:
    """``runs`` in the order of one of ``SORT_KEYS``; ties in the order of run_id."""
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key}")
    return runs.orderBy(F.col(key).desc() if descending else F.col(key).asc(), "run_id")


def leaderboard(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """rank, run_id, f1, band of all runs, or of the ``limit`` best.

    Ranks come from counts in 64 ranges of F1 and a rank within each, so no task orders all runs.
    """
    top = runs if limit is None else runs.orderBy(F.desc("f1"), "run_id").limit(limit)
    top = top.select("run_id", "f1", F.least(F.greatest(F.floor(F.coalesce("f1", F.lit(0.0)) * 64), F.lit(0)), F.lit(64)).alias("range"))
    sizes = top.groupBy("range").agg(F.count("*").alias("n"))  # 65 rows
    above = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("f1"), "run_id"))
    ranked_ = top.withColumn("k", within).join(F.broadcast(above), "range")
    return ranked_.select((F.col("above") + F.col("k")).alias("rank"), "run_id", "f1", scores.band(F.col("f1")).alias("band")).orderBy("rank")


def latest(runs: DataFrame) -> DataFrame:
    """The run with the latest instant (unreadable ones count as 0), ties to the greater run_id."""
    return runs.orderBy(scores.parse_instant(F.col("created_at")).desc(), F.desc("run_id")).limit(1)


def exposition(runs: DataFrame, metrics: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """metric, run_id, labels, value of micro rates, with escaped label values."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    rows = runs.select("run_id", _braces(_labels(["run_id", "model", "split"])).alias("labels"), each.alias("x"))
    return rows.select(F.concat(F.lit("ner_"), F.col("x.metric")).alias("metric"), "run_id", "labels", F.col("x.value").alias("value"))


def _labels(names: list[str]) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit(f'{n}="'), tx.escape_label_value(F.col(n)), F.lit('"')) for n in names])


def _braces(inside: Column) -> Column:
    return F.concat(F.lit("{"), inside, F.lit("}"))


#: fixed values: names and help of the gauges
GAUGES = {
    "ner_eval_precision": "Exact-span precision", "ner_eval_recall": "Exact-span recall", "ner_eval_f1": "Exact-span F1",
    "ner_eval_records": "Gold documents in the scored split", "ner_eval_created_timestamp_seconds": "Run created_at as Unix seconds", "ner_eval_latest": "1 if this is the newest registered run",
    "ner_eval_boundary_f1": "Type-agnostic exact (start,end) F1; not the organizer score", "ner_eval_type_accuracy": "Label accuracy on spans with matching character offsets", "ner_eval_error_bucket": "Diagnostic entity counts (not organizer TP/FP)",
}


def gauges(runs: DataFrame, scopes: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """metric, run_id, labels, value of every gauge.

    runs: run_id, model, split, created_at, records; scopes: run_id, scope, precision, recall,
    f1 (micro, macro and every label); diagnostics: run_id, boundary_f1, type_accuracy and the
    six error buckets.
    """
    ids = ["run_id", "model", "split"]
    each = lambda cols: F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in cols.items()])).alias("x")
    by = scopes.join(runs.select(*ids), "run_id").withColumnRenamed("scope", "label")
    rates = by.select("run_id", _braces(_labels([*ids, "label"])).alias("labels"), each({f"ner_eval_{m}": F.col(m) for m in ("precision", "recall", "f1")}))
    newest = latest(runs).select(F.col("run_id").alias("_newest"))
    own = runs.join(F.broadcast(newest), F.lit(True), "left")  # one row
    flag = F.coalesce((F.col("run_id") == F.col("_newest")).cast("int"), F.lit(0))
    rest = own.select("run_id", _braces(_labels(ids)).alias("labels"), each({"ner_eval_records": F.col("records"), "ner_eval_created_timestamp_seconds": scores.parse_instant(F.col("created_at")), "ner_eval_latest": flag}))
    out = rates.unionByName(rest)
    if diagnostics is not None:
        diag = diagnostics.join(runs.select(*ids), "run_id")
        out = out.unionByName(diag.select("run_id", _braces(_labels(ids)).alias("labels"), each({"ner_eval_boundary_f1": F.col("boundary_f1"), "ner_eval_type_accuracy": F.col("type_accuracy")})))
        names = ["exact_match", "type_mismatch", "partial_same_type", "partial_diff_type", "missed", "spurious"]
        bars = diag.select(*ids, F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(n).alias("value")) for n in names])).alias("b")).select(*ids, "b.*")
        out = out.unionByName(bars.select("run_id", _braces(_labels([*ids, "bucket"])).alias("labels"), F.struct(F.lit("ner_eval_error_bucket").alias("metric"), F.col("value").cast("double").alias("value")).alias("x")))
    return out.select("x.metric", "run_id", "labels", "x.value")


def exposition_lines(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """(metric_no, part, run_id, labels, line) of the text format, and the columns that order it: help, type, then samples by run and labels.

    Gauges without a sample have no lines.
    """
    spark = rows.sparkSession
    about = spark.createDataFrame([(i, name, f"# HELP {name} {text}") for i, (name, text) in enumerate(GAUGES.items())], "metric_no int, metric string, help string")
    known = F.broadcast(about)  # the gauges' names
    heads = rows.select("metric").distinct().join(known, "metric")
    heads = heads.select("metric_no", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("help").alias("line")), F.struct(F.lit(1).alias("part"), F.concat(F.lit("# TYPE "), "metric", F.lit(" gauge")).alias("line")))).alias("x")).select("metric_no", "x.*")
    samples = rows.join(known, "metric").select("metric_no", F.lit(2).alias("part"), "run_id", "labels", "value", F.concat("metric", "labels", F.lit(" "), F.col("value").cast("string")).alias("line"))
    return samples.unionByName(heads, allowMissingColumns=True), ["metric_no", "part", "run_id", "labels", "value"]


def write_exposition(rows: DataFrame, path: str) -> None:
    """The text format of gauges, of any number of samples, as an ordered text in the folder ``path``."""
    write_lines(*exposition_lines(rows), path)


def exposition_text(rows: DataFrame) -> str:
    """The text format of gauges as one string, for a registry that fits one (see ``write_exposition``)."""
    lines, order = exposition_lines(rows)
    return "".join(r["line"] + "\n" for r in lines.orderBy(*order).toLocalIterator()) or "\n"


def only_latest(samples: DataFrame) -> DataFrame:
    """Samples of the newest run: a join of many to one on run_id, as of ``metric * on(run_id) group_left() (latest == 1)``."""
    newest = samples.filter("metric = 'ner_eval_latest' and value = 1").select("run_id").distinct()
    return samples.filter("metric <> 'ner_eval_latest'").join(newest, "run_id", "left_semi")


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run of this id, or no row; an id that could not be one is no error."""
    return valid_ids(runs).filter(F.col("run_id") == run_id)


def incomplete_runs(runs: DataFrame, labels: tuple[str, ...] = ("ORG", "NAME", "GEO")) -> DataFrame:
    """run_id, missing: labels that metrics.by_label lacks."""
    have = F.coalesce(F.map_keys("metrics.by_label"), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, labels)), have)
    return runs.select("run_id", missing.alias("missing")).filter(F.size("missing") > 0)


def flat_metrics(runs: DataFrame) -> DataFrame:
    """run_id and seven flat columns of nested metrics: the micro rates and counts, and macro F1."""
    m = F.col("metrics")
    return runs.select("run_id", *[m["micro"][c].alias(f"micro_{c}") for c in ("precision", "recall", "f1", "tp", "fp", "fn")], m["macro"]["f1"].alias("macro_f1"))


def build_run(scopes: DataFrame, records: int, run_id: str, model: str, created_at: str, split: str = "official_dev", checkpoint: str = "", hyperparams: dict[str, str] | None = None) -> DataFrame:
    """One run document from the rows of ``exact_metrics``; raises on an id that is no plain file name."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    one = F.struct("precision", "recall", "f1", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"))
    of = lambda name: F.max(F.when(F.col("scope") == name, one))
    labels = F.map_from_entries(F.sort_array(F.collect_list(F.when(~F.col("scope").isin("micro", "macro"), F.struct("scope", one.alias("v"))))))
    metrics = scopes.agg(F.lit(records).cast("long").alias("records"), labels.alias("by_label"), of("micro").alias("micro"), of("macro").alias("m"))
    metrics = metrics.select(F.struct("records", "by_label", "micro", F.struct("m.precision", "m.recall", "m.f1").alias("macro")).alias("metrics"))
    params = F.create_map(*[F.lit(x) for kv in (hyperparams or {}).items() for x in kv]) if hyperparams else F.create_map().cast("map<string,string>")
    return metrics.select(*[F.lit(v).alias(n) for n, v in (("run_id", run_id), ("model", model), ("checkpoint", checkpoint), ("created_at", created_at), ("split", split))], params.alias("hyperparams"), "metrics")


def register(spark: SparkSession, gold: DataFrame, pred: DataFrame, path: str, **about: str) -> DataFrame:
    """Scores spans, writes the run to the registry at ``path``, and gives it back; about: see ``build_run``."""
    from spanforge.operators import scoring as sc

    run = build_run(sc.exact_metrics(gold, pred), gold.select("doc_id").distinct().count(), **about)
    upsert(spark, run, path)
    return run


def scale(spark: SparkSession) -> DataFrame:
    """ord, band, least, below: the bands of F1."""
    return spark.createDataFrame([(i, *b) for i, b in enumerate(scores.BANDS)], "ord int, band string, least double, below double")


def band_counts(runs: DataFrame) -> DataFrame:
    """ord, band, least, below, runs, best: how many runs each band of F1 holds (0 for none), and the best of them."""
    n = runs.groupBy(scores.band(F.col("f1")).alias("band")).agg(F.count("*").alias("runs"), F.max("f1").alias("best"))
    return F.broadcast(scale(runs.sparkSession)).join(n, "band", "left").select("ord", "band", "least", "below", F.coalesce("runs", F.lit(0)).alias("runs"), "best")


def upsert(spark, runs: DataFrame, path: str) -> None:
    """Write runs as partitions by run_id; runs that are written again replace the old ones."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)
