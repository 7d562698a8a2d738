"""Confidence calibration over (id, k, z) logits and over entity confidences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.operators import places as pl
from spanforge.operators import spans as sp


def probabilities(logits: DataFrame, keys: list[str], temperature: Column | float = 1.0) -> DataFrame:
    """``logits`` (keys, k, z) with p: softmax over k, by plain aggregates over rows."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    own = Window.partitionBy(*keys)
    rows = logits.withColumn("e", F.exp((F.col("z").cast("double") - F.max(F.col("z").cast("double")).over(own)) / t))
    return rows.withColumn("p", F.col("e") / F.sum("e").over(own)).drop("e")


def predicted(p: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pred (the first k with the greatest p), conf, and p of ``gold`` as p_gold."""
    return p.groupBy(*keys).agg(
        F.max_by("k", F.struct(F.col("p"), -F.col("k"))).alias("pred"), F.max("p").alias("conf"),
        F.max(F.when(F.col("k") == F.col("gold"), F.col("p"))).alias("p_gold"), F.first("gold").alias("gold"),
        F.sum((F.col("p") - (F.col("k") == F.col("gold")).cast("double")) * (F.col("p") - (F.col("k") == F.col("gold")).cast("double"))).alias("brier"),
    )


def nll(p_gold: Column) -> Column:
    return F.coalesce(F.avg(-F.ln(F.least(F.greatest(p_gold, F.lit(1e-12)), F.lit(1.0)))), F.lit(0.0))


def reliability(rows: DataFrame, conf: str, correct: Column, n_bins: int = 10, extra: list[str] | None = None) -> DataFrame:
    """bin, n, conf, acc, gap of all bins, empty ones with zeros."""
    extra = extra or []
    got = rows.groupBy(*extra, scores.bin_of(F.col(conf), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("conf"), F.avg(correct.cast("double")).alias("acc"))
    dim = rows.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    if extra:
        dim = got.select(*extra).distinct().crossJoin(F.broadcast(dim))
    full = dim.join(got, [*extra, "bin"], "left").select(*extra, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("conf", F.lit(0.0)).alias("conf"), F.coalesce("acc", F.lit(0.0)).alias("acc"))
    return full.withColumn("gap", F.col("conf") - F.col("acc"))


def ece(bins: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Expected calibration error: bins' gaps weighted by their rows; 0 without rows."""
    total = F.sum("n")
    return bins.groupBy(*(extra or [])).agg(F.coalesce(F.try_divide(F.sum(F.abs("gap") * F.col("n")), total), F.lit(0.0)).alias("ece"), total.alias("n"))


def binary(rows: DataFrame, conf: str, correct: str, n_bins: int = 10) -> DataFrame:
    """n, mean_conf, accuracy, brier, ece, reading of entity confidences; zeros without rows."""
    y = F.col(correct).cast("double")
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(conf), F.lit(0.0)).alias("mean_conf"), F.coalesce(F.avg(y), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg((F.col(conf) - y) * (F.col(conf) - y)), F.lit(0.0)).alias("brier"))
    error = ece(reliability(rows, conf, F.col(correct), n_bins)).select("ece")
    return whole.crossJoin(error).withColumn("reading", scores.confidence_reading(F.col("mean_conf") - F.col("accuracy")))


def merged_logits(windows: DataFrame) -> DataFrame:
    """Mean logits per (doc_id, start, end, k) over the windows that hold a token; special tokens are dropped."""
    return windows.filter("start < end").groupBy("doc_id", "start", "end", "k").agg(F.avg(F.col("z").cast("double")).cast("float").alias("z"), F.count("*").alias("n"))


def merged_probabilities(windows: DataFrame) -> DataFrame:
    """Mean probabilities: softmax in each window first."""
    p = probabilities(windows.filter("start < end"), ["doc_id", "window", "start", "end"])
    return p.groupBy("doc_id", "start", "end", "k").agg(F.avg("p").alias("p"))


def entity_confidence(spans: DataFrame, toks: DataFrame, mode: str = "mean") -> DataFrame:
    """``spans`` with conf: mean or max over the tokens inside (0 without one); toks: doc_id, start, end, conf."""
    agg = F.avg("conf") if mode == "mean" else F.max("conf")
    return sp.meetings(toks, spans, ["conf"], inside=True).groupBy(*spans.columns).agg(F.coalesce(agg, F.lit(0.0)).alias("conf"))


def piece_confidence(spans: DataFrame, docs: DataFrame, conf: Callable[[Column], Column]) -> DataFrame:
    """Distinct ``spans`` with conf: the mean over the pieces inside (0 without one), of which ``conf`` gives the confidence.

    As ``entity_confidence`` with the pieces of the texts as tokens, which are neither made nor shuffled as rows.
    """
    rows = pl.around(spans, docs, "pieces", distinct=True)
    total = F.aggregate(F.transform("pieces", conf), F.lit(0.0), lambda a, x: a + x)
    return rows.select(*spans.columns, F.when(F.size("pieces") > 0, total / F.size("pieces")).otherwise(0.0).alias("conf"))


def entity_mass(spans: DataFrame, toks: DataFrame) -> DataFrame:
    """``spans`` with mass: mean over the overlapping tokens; toks: doc_id, start, end, mass."""
    return sp.meetings(toks, spans, ["mass"], inside=False).groupBy(*spans.columns).agg(F.coalesce(F.avg("mass"), F.lit(0.0)).alias("mass"))


def gold_tokens(toks: DataFrame, label: str = "gold") -> DataFrame:
    """Tokens that count in training: those with a label of 0 or more."""
    return toks.filter(F.col(label) >= 0)


def slim(metrics: DataFrame, columns: tuple[str, ...] = ("bins",)) -> DataFrame:
    """Metrics without their long columns."""
    return metrics.drop(*columns)
