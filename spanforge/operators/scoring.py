"""Strict span scoring and its diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.operators import spans as sp

LABELS = ("ORG", "NAME", "GEO")
KEYS = ["doc_id", "label", "start", "end"]


def sides(gold: DataFrame, pred: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Distinct keys of both, with g and p (1 where present): one shuffle for both sides."""
    extra = extra or []
    both = gold.select(*extra, *keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*extra, *keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    return both.groupBy(*extra, *keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))


def counts() -> list[Column]:
    g, p = F.col("g"), F.col("p")
    return [F.sum(g * p).alias("tp"), F.sum(p * (1 - g)).alias("fp"), F.sum(g * (1 - p)).alias("fn")]


def document_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, label, tp, fp, fn: what groups of documents are scored from, a few rows a document.

    One exchange by doc_id serves both aggregates; spans meet no other table.
    """
    both = gold.select(*KEYS, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*KEYS, F.lit(0).alias("g"), F.lit(1).alias("p"))).repartition("doc_id")
    return both.groupBy(*KEYS).agg(F.max("g").alias("g"), F.max("p").alias("p")).groupBy("doc_id", "label").agg(*counts())


def with_prf(df: DataFrame) -> DataFrame:
    p, r, f = scores.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return df.withColumns({"precision": p, "recall": r, "f1": f})


def exact_metrics(gold: DataFrame, pred: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """scope (a label, micro or macro), tp, fp, fn, precision, recall, f1 by ``extra``.

    Labels that do not occur count zero; macro is the plain mean over the three labels and
    has zero counts.
    """
    g, p = F.col("g"), F.col("p")
    one = sides(gold, pred, KEYS, extra).select(*(extra or []), "label", (g * p).alias("tp"), (p * (1 - g)).alias("fp"), (g * (1 - p)).alias("fn"))
    return scope_metrics(one, extra)


def scope_metrics(counted: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The scopes of ``exact_metrics`` from rows of extra, label, tp, fp, fn."""
    extra = extra or []
    sums = {n: F.col(n) for n in ("tp", "fp", "fn")}
    # one aggregate for all scopes: three sums a label, from which the others follow in the row
    wide = counted.groupBy(*extra).agg(*[F.coalesce(F.sum(F.when(F.col("label") == x, c)), F.lit(0)).cast("long").alias(f"{x}_{n}") for x in LABELS for n, c in sums.items()])

    def scope(name: str, counts_: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("scope"), *[c.alias(n) for n, c in zip(("tp", "fp", "fn"), counts_, strict=True)], *[c.alias(n) for n, c in zip(("precision", "recall", "f1"), scores.prf(*counts_), strict=True)])

    each = [[F.col(f"{x}_{n}") for n in sums] for x in LABELS]
    micro = [c[0] + c[1] + c[2] for c in zip(*each, strict=True)]
    rates = [scores.prf(*c) for c in each]
    zero = F.lit(0).cast("long")
    macro = F.struct(F.lit("macro").alias("scope"), *[zero.alias(n) for n in sums], *[((r[0] + r[1] + r[2]) / len(LABELS)).alias(n) for n, r in zip(("precision", "recall", "f1"), zip(*rates, strict=True), strict=True)])
    return wide.select(*extra, F.explode(F.array(*[scope(x, c) for x, c in zip(LABELS, each, strict=True)], scope("micro", micro), macro)).alias("x")).select(*extra, "x.*")


def boundary_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of spans without their labels."""
    return with_prf(sides(gold, pred, ["doc_id", "start", "end"]).agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counts(), ("tp", "fp", "fn"), strict=True)]))


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold_label, pred_label, n over all label pairs, from spans with one label on each side."""
    one = lambda df, n: df.groupBy("doc_id", "start", "end").agg(F.count_distinct("label").alias("k"), F.min("label").alias(n)).filter("k = 1").drop("k")
    n = one(gold, "gold_label").join(one(pred, "pred_label"), ["doc_id", "start", "end"]).groupBy("gold_label", "pred_label").agg(F.count("*").alias("n"))
    dim = gold.sparkSession.createDataFrame([(x, y) for x in LABELS for y in LABELS], "gold_label string, pred_label string")
    return F.broadcast(dim).join(n, ["gold_label", "pred_label"], "left").select("gold_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def paired(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, exact, shared, n_gold, n_pred, pairs of each cluster of overlapping spans.

    Exact keys go first; then (unless they only differ in labels, which is ``shared``) the
    gold and predicted spans left pair greedily. One exchange by doc_id serves it all.
    """
    both = sides(gold, pred, KEYS).repartition("doc_id")
    span = Window.partitionBy("doc_id", "start", "end")
    exact = F.col("g") * F.col("p") == 1
    only_g, only_p = F.max((~exact & (F.col("g") == 1)).cast("int")).over(span), F.max((~exact & (F.col("p") == 1)).cast("int")).over(span)
    rows = both.withColumn("exact", exact).withColumn("shared", ~F.col("exact") & (only_g + only_p == 2))
    rows = rows.withColumn("first", F.col("shared") & (F.row_number().over(span.orderBy(F.desc("shared"), "label")) == 1))
    item = F.struct("start", "end", "label")
    left = lambda c: F.collect_list(F.when(~F.col("exact") & ~F.col("shared") & (F.col(c) == 1), item))
    held = sp.clusters(rows, ["doc_id"]).groupBy("doc_id", "cluster").agg(F.count_if("exact").alias("exact"), F.count_if("first").alias("shared"), left("g").alias("golds"), left("p").alias("preds"))
    return held.select("doc_id", "exact", "shared", F.size("golds").alias("n_gold"), F.size("preds").alias("n_pred"), sp.greedy_pairs().alias("pairs"))


def error_buckets(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """bucket, n: exact_match, type_mismatch, partial_same_type, partial_diff_type, missed, spurious.

    A span that stands on both sides with other labels is one mismatch and uses up all its
    labels; what has no partner is missed or spurious.
    """
    held = paired(gold, pred)
    same = F.size(F.filter("pairs", lambda x: x["g_label"] == x["p_label"]))
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    n = held.agg(total("exact", "exact_match"), total("shared", "type_mismatch"), total(same, "partial_same_type"), total(F.size("pairs") - same, "partial_diff_type"), total(F.col("n_gold") - F.size("pairs"), "missed"), total(F.col("n_pred") - F.size("pairs"), "spurious"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("bucket"), F.col(c).alias("n")) for c in n.columns])).alias("x")).select("x.bucket", "x.n")


def error_analysis(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: the buckets, boundary F1, type accuracy on aligned spans, and the reading."""
    from spanforge.functions.scores import error_reading, ratio

    names = ["exact_match", "type_mismatch", "partial_same_type", "partial_diff_type", "missed", "spurious"]
    wide = error_buckets(gold, pred).groupBy().pivot("bucket", names).agg(F.first("n"))
    types = confusion(gold, pred).agg(F.sum("n").alias("aligned"), F.sum(F.when(F.col("gold_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("right"))
    out = wide.crossJoin(boundary_metrics(gold, pred).select(F.col("f1").alias("boundary_f1"))).crossJoin(types.select(ratio(F.col("right"), F.col("aligned")).alias("type_accuracy")))
    return out.withColumn("reading", error_reading(*[F.col(n) for n in names], F.col("type_accuracy"), F.col("boundary_f1")))


def offset_pairs(gold: DataFrame, pred: DataFrame, same_label: bool = True) -> DataFrame:
    """doc_id, label, d_start, d_end (predicted less gold) of greedy pairs of spans that are not exact.

    Pairs of different labels use up their spans, but count only without ``same_label``.
    """
    return pairs_of_sides(sides(gold, pred, KEYS), same_label)


def pairs_of_sides(both: DataFrame, same_label: bool = True) -> DataFrame:
    """``offset_pairs`` from the rows of ``sides``."""
    both = both.filter("g + p = 1").repartition("doc_id")
    item = F.struct("start", "end", "label")
    held = sp.clusters(both, ["doc_id"]).groupBy("doc_id", "cluster").agg(F.collect_list(F.when(F.col("g") == 1, item)).alias("golds"), F.collect_list(F.when(F.col("p") == 1, item)).alias("preds"))
    held = held.filter((F.size("golds") > 0) & (F.size("preds") > 0))
    pairs = held.select("doc_id", F.explode(sp.greedy_pairs()).alias("x"))
    if same_label:
        pairs = pairs.filter("x.g_label = x.p_label")
    return pairs.select("doc_id", F.col("x.g_label").alias("label"), (F.col("x.p_start") - F.col("x.g_start")).alias("d_start"), (F.col("x.p_end") - F.col("x.g_end")).alias("d_end"))


def offset_modes(pairs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """extra, label (or ALL), d_start, d_end: the marginal modes."""
    keys = [*(extra or []), "label"]
    rows = pairs.withColumn("label", F.explode(F.array("label", F.lit("ALL"))))
    return sp.mode_of(rows, keys, "d_start").withColumnRenamed("mode", "d_start").join(sp.mode_of(rows, keys, "d_end").withColumnRenamed("mode", "d_end"), keys)


def joint_offset_mode(pairs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """extra, d_start, d_end: the most frequent pair of offsets; ties to the smaller moves, then the smaller offsets."""
    n = pairs.groupBy(*(extra or []), "d_start", "d_end").agg(F.count("*").alias("n"))
    first = F.max_by(F.struct("d_start", "d_end"), F.struct("n", -(F.abs("d_start") + F.abs("d_end")), -F.col("d_start"), -F.col("d_end"))).alias("m")
    return n.groupBy(*(extra or [])).agg(first).select(*(extra or []), "m.d_start", "m.d_end")


def missing_keys(gold: DataFrame, pred: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """side, key: the first keys that only one side has."""
    only = lambda a, b, n: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").orderBy(key).limit(limit).withColumn("side", F.lit(n))
    return only(gold, pred, "missing").unionByName(only(pred, gold, "extra"))


def key_totals(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """One row: how many keys only gold has (missing), only the predictions have (extra), and both."""
    both = gold.select(key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(key, F.lit(0).alias("g"), F.lit(1).alias("p"))).groupBy(key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return both.agg(F.count_if(F.col("p") == 0).alias("missing"), F.count_if(F.col("g") == 0).alias("extra"), F.count_if(F.col("g") + F.col("p") == 2).alias("both"))


def changed_texts(gold: DataFrame, pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys whose predicted record carries another text than the gold one; records without a text are taken."""
    mine = pred.select(key, F.col("text").alias("_t")).filter("_t is not null")
    return gold.select(key, "text").join(mine, key).filter("_t <> text").select(key)


def aligned_records(gold: DataFrame, pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, gold entities, predicted entities, one to one; raises on missing, extra or repeated keys and on changed texts.

    gold: key, text, entities; pred: key, entities and perhaps text.
    """
    n = key_totals(gold, pred, key).first()
    if n["missing"] or n["extra"]:
        some = ", ".join(f"{r['side']} {r[key]}" for r in missing_keys(gold, pred, key).collect())
        raise ValueError(f"keys differ: {n['missing']} missing, {n['extra']} extra ({some})")
    for name, df in (("gold", gold), ("predictions", pred)):
        twice = df.groupBy(key).count().filter("count > 1").orderBy(key).limit(5).collect()
        if twice:
            raise ValueError(f"repeated keys in {name}: {', '.join(str(r[key]) for r in twice)}")
    if "text" in pred.columns:
        other = changed_texts(gold, pred, key).orderBy(key).limit(5).collect()
        if other:
            raise ValueError(f"texts differ: {', '.join(str(r[key]) for r in other)}")
    return gold.select(key, F.col("entities").alias("gold")).join(pred.select(key, F.col("entities").alias("pred")), key)
