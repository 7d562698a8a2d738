"""Validation predicates and corpus profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import spans as sp
from spanforge.operators.scoring import LABELS
from spanforge.sources.shared import written


def record_error(hash_: Column, text: Column) -> Column:
    return F.when(hash_.isNull() | (hash_ == ""), "hash").when(text.isNull(), "text")


def span_error(label: Column, start: Column, end: Column, text: Column) -> Column:
    """The first rule that a span breaks, or null."""
    return (
        F.when(~F.coalesce(label.isin(*LABELS), F.lit(False)), "label")
        .when(start.isNull() | end.isNull() | (start < 0) | (start >= end), "offsets")
        .when(end > F.length(text), "length")
    )


def duplicate_spans(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "label", "start", "end").agg(F.count("*").alias("n")).filter("n > 1")


def overlapping_spans(spans: DataFrame) -> DataFrame:
    """Spans that begin before the one before them, by (start, end, label), has ended."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "label")
    return spans.withColumn("prev_end", F.lag("end").over(order)).filter("prev_end > start")


def integrity(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of counters: overlapping and nested pairs, invalid, empty, outer blanks and punctuation."""
    rows = sp.with_surface(spans, docs).withColumnRenamed("surface", "s")
    flags = rows.agg(
        F.count("*").alias("n"),
        F.count_if((F.col("start") < 0) | (F.col("start") >= F.col("end"))).alias("invalid"),
        F.count_if(F.trim("s") == "").alias("empty"),
        F.count_if(F.col("s").rlike(r"^[ \t\n]")).alias("leading_space"),
        F.count_if(F.col("s").rlike(r"[ \t\n]$")).alias("trailing_space"),
        F.count_if(F.col("s").rlike("^[«»\"'“”()\\[\\]{}#@.,;:!?…]|[«»\"'“”()\\[\\]{}#@.,;:!?…]$")).alias("edge_punct"),
    )
    before = F.struct("a.start", "a.end", "a.label") < F.struct("b.start", "b.end", "b.label")
    pairs = sp.overlapping_pairs(spans, spans).filter(before)
    nested = (F.col("a.start") <= F.col("b.start")) & (F.col("b.end") <= F.col("a.end")) | (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    return flags.crossJoin(pairs.agg(F.count("*").alias("overlap"), F.count_if(nested).alias("nested")))


def ranked_values(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, value, k (rows that have it), upto (rows up to it), n (all rows of the key).

    Values are counted, and the counts summed in about 64 ranges of the values, so that no
    task orders all different values of a key.
    """
    keys = keys or []
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("k"))
    cuts = n.groupBy(*keys).agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)], 1000).alias("cuts"), F.sum("k").alias("n"))
    rows = n.join(cuts, keys) if keys else n.crossJoin(F.broadcast(cuts))  # one row a key; without keys one row
    rows = rows.withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # 64 rows a key
    base = rows.groupBy(*keys, "b").agg(F.sum("k").alias("s")).select(*keys, "b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*keys, "b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("w", F.sum("k").over(within)).join(base, [*keys, "b"]).select(*keys, "value", "k", (F.col("base") + F.col("w")).alias("upto"), "n")


def numeric_summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, min, p50, mean, p90, p95, p99, max; percentiles lie between the two nearest ranks. Zeros and nulls without rows."""
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))

    def percentile(p: float) -> Column:
        rank = F.lit(p) * (F.col("n") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        return (low + (high - low) * F.max(rank - F.floor(rank))).alias(f"p{round(p * 100)}")

    v, k = F.col("value"), F.col("k")
    out = ranked_values(df, value, keys).groupBy(*(keys or [])).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_"), F.min(v).alias("min"), percentile(0.5), (F.sum(v * k) / F.sum(k)).alias("mean"), percentile(0.9), percentile(0.95), percentile(0.99), F.max(v).alias("max"))
    return out.withColumnRenamed("n_", "n")


def nearest_rank(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """p, value at rank round-half-even(p * (n - 1))."""
    ranks = [F.bround(F.lit(p) * (F.col("n") - 1)) for p in shares]
    wide = ranked_values(df, value).agg(*[F.min(F.when(F.col("upto") > r, F.col("value"))).alias(f"v{i}") for i, r in enumerate(ranks)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"v{i}").alias("value")) for i, p in enumerate(shares)])).alias("x")).select("x.*").filter("value is not null")


def surfaces(spans: DataFrame, docs: DataFrame) -> DataFrame:
    return sp.with_surface(spans, docs).select("doc_id", "label", F.lower("surface").alias("surface"))


#: buckets that surfaces are counted in first, and how many of the fullest are counted exactly at once
BUCKETS, FULLEST = 1 << 16, 1024


def _bucketed(named: DataFrame) -> DataFrame:
    return named.select("label", "surface", F.pmod(F.xxhash64("surface"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _survivors(rows: DataFrame, sizes: DataFrame, by: list[str], count: Callable[[DataFrame], DataFrame], kth: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Exact counts (``count``) of all surfaces that can be among the first, and of few others.

    A heavy-hitter sketch: sizes (by, bucket, n) hold how many surfaces fell into each bucket, so
    none of a bucket is more frequent than the bucket is full. The surfaces of the fullest
    buckets are counted exactly; ``kth`` gives the count that is needed to come in. Buckets
    less full than that hold no surface that does, and the others, if any are left, are counted
    too. Ties with the k-th are kept. What is shuffled is a bounded table of buckets and the
    surfaces of these buckets, not all surfaces.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "bucket"))
    ranked_ = sizes.withColumn("k", rank)
    some = lambda buckets: count(rows.join(F.broadcast(buckets.select(*by, "bucket")), [*by, "bucket"]))  # noqa: E731  (BUCKETS rows a key at most)
    got = written(some(ranked_.filter(F.col("k") <= FULLEST)), "heavy")
    need = kth(got)
    left = ranked_.filter(F.col("k") > FULLEST)
    left = written((left.join(F.broadcast(need), by, "left") if by else left.crossJoin(F.broadcast(need))).filter(F.col("n") >= F.coalesce("need", F.lit(0))), "left")
    return got.unionByName(some(left)) if left.limit(1).count() else got


def ambiguous(named: DataFrame, limit: int = 40) -> DataFrame:
    """surface, labels, total of surfaces with several labels, the most frequent first."""
    rows = _bucketed(named)
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).filter("labels > 1").select("bucket", "n"), "buckets")
    count = lambda df: df.groupBy("surface").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("total")).filter("labels > 1")
    kth = lambda got: got.orderBy(F.desc("total")).limit(limit).agg(F.when(F.count("*") == limit, F.min("total")).otherwise(0).alias("need"))
    return _survivors(rows, sizes, [], count, kth).orderBy(F.desc("total"), F.desc(F.length("surface")), "surface").limit(limit)


def top_per_label(named: DataFrame, k: int = 25) -> DataFrame:
    """label, surface, n, rank of the k most frequent surfaces of each label, ties in the order of the surfaces."""
    rows = _bucketed(named)
    sizes = written(rows.groupBy("label", "bucket").agg(F.count("*").alias("n")), "buckets")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "surface"))
    count = lambda df: df.groupBy("label", "surface").agg(F.count("*").alias("n"))
    kth = lambda got: got.withColumn("rank", rank).filter(F.col("rank") == k).select("label", F.col("n").alias("need"))
    return _survivors(rows, sizes, ["label"], count, kth).withColumn("rank", rank).filter(F.col("rank") <= k)


def inflected_pairs(named: DataFrame, endings: list[str], least: int = 3) -> DataFrame:
    """label, stem, inflected, total: surfaces that are another surface of the label plus an ending."""
    n = named.groupBy("label", "surface").agg(F.count("*").alias("n"))
    ends = F.filter(F.array(*map(F.lit, endings)), lambda e: (F.length("surface") >= F.length(e) + least) & F.endswith(F.col("surface"), e))
    cut = n.select("label", F.col("surface").alias("inflected"), F.col("n").alias("m"), F.explode(ends).alias("ending"))
    cut = cut.withColumn("stem", F.substring("inflected", F.lit(1), F.length("inflected") - F.length("ending")))
    return cut.join(n.withColumnRenamed("surface", "stem"), ["label", "stem"]).select("label", "stem", "inflected", (F.col("n") + F.col("m")).alias("total"))


def surface_overlap(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """label, ours, theirs, both, either, jaccard, recall of the surface sets."""
    both = ours.select("label", "surface", F.lit(1).alias("o"), F.lit(0).alias("t")).unionByName(theirs.select("label", "surface", F.lit(0).alias("o"), F.lit(1).alias("t")))
    sets = both.groupBy("label", "surface").agg(F.max("o").alias("o"), F.max("t").alias("t"))
    out = sets.groupBy("label").agg(F.sum("o").alias("ours"), F.sum("t").alias("theirs"), F.sum(F.col("o") * F.col("t")).alias("both"), F.count("*").alias("either"))
    return out.withColumns({"jaccard": F.col("both") / F.col("either"), "recall": F.coalesce(F.try_divide("both", "ours"), F.lit(0.0))})


def signatures(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """signature, docs: label sets of documents, those without spans too."""
    labels = spans.groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    own = docs.select("doc_id").join(labels, "doc_id", "left")
    return own.groupBy(tx.label_signature(F.coalesce("labels", F.array().cast("array<string>"))).alias("signature")).agg(F.count("*").alias("docs"))


def cooccurrence(spans: DataFrame) -> DataFrame:
    """a, b, docs: documents that hold both labels; each document pairs its few distinct labels."""
    sets = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("l"))
    pairs = sets.select(F.posexplode("l").alias("i", "a"), "l").select("a", F.explode(F.expr("slice(l, i + 2, size(l))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("docs"))


def bucket_parameters(tensors: DataFrame) -> DataFrame:
    """bucket, parameters, share, examples of (name, shape) rows."""
    from spanforge.functions.scores import size_product

    rows = tensors.select("name", tx.tensor_bucket(F.col("name")).alias("bucket"), size_product(F.col("shape")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("name"))
    some = rows.withColumn("k", rank).filter("k <= 8").groupBy("bucket").agg(F.array_sort(F.collect_list("name")).alias("examples"))
    out = rows.groupBy("bucket").agg(F.sum("n").alias("parameters")).join(some, "bucket")
    return out.withColumn("share", F.col("parameters") / F.sum("parameters").over(Window.partitionBy()))


# further corpus profiles


def corpus_profile(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """measure, value of a labelled corpus: documents, spans, lengths of both (by label too), long documents, attached suffixes, span issues."""
    size = docs.select("doc_id", F.length("text").alias("chars"), tx.word_count(F.col("text")).alias("words"))
    # what many branches read is written once: the sizes, the spans, and what is counted of their surfaces
    size, spans = written(size, "sizes"), written(spans, "spans")
    named = sp.with_surface(spans, docs)
    named = written(named.select("label", "doc_id", F.length("surface").alias("chars"), tx.word_count(F.col("surface")).alias("words"), (tx.surface_suffix(F.col("surface")) != "").alias("suffixed")), "surfaces")
    n = size.agg(F.count("*").alias("docs"), F.count_if(F.col("words") > 300).alias("docs_over_300_words"), F.count_if(F.col("words") > 400).alias("docs_over_400_words"))
    e = named.agg(F.count("*").alias("entities"), F.count_distinct("doc_id").alias("docs_with_entities"), F.count_if("suffixed").alias("with_attached_suffix"))
    both = n.crossJoin(e)
    both = both.withColumns({
        "docs_empty": F.col("docs") - F.col("docs_with_entities"), "empty_doc_percent": F.coalesce(F.round(F.try_divide((F.col("docs") - F.col("docs_with_entities")) * 100.0, F.col("docs")), 2), F.lit(0.0)),
        "entities_per_doc": F.coalesce(F.round(F.try_divide(F.col("entities").cast("double"), F.col("docs")), 3), F.lit(0.0)), "attached_suffix_percent": F.coalesce(F.round(F.try_divide(F.col("with_attached_suffix") * 100.0, F.col("entities")), 2), F.lit(0.0)),
    })
    dupes = duplicate_spans(spans).agg(F.count("*").alias("duplicate_spans"))
    issues = integrity(spans, docs).drop("n").crossJoin(dupes)

    def long(df: DataFrame, prefix: Column | None = None) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("value")) for c in df.columns if c != "label"])).alias("x")
        name = F.col("x.m") if prefix is None else F.concat(prefix, F.lit("."), F.col("x.m"))
        return df.select(*(["label"] if "label" in df.columns else []), each).select(name.alias("measure"), "x.value")

    out = long(both).unionByName(long(issues, F.lit("issues")))
    for name, df, value in (("text_chars", size, "chars"), ("text_words", size, "words"), ("entity_chars", named, "chars"), ("entity_words", named, "words")):
        out = out.unionByName(long(numeric_summary(df, value), F.lit(name)))
    return out.unionByName(long(numeric_summary(named, "chars", ["label"]), F.concat(F.lit("entity_chars_by_label."), F.col("label"))))


def markdown(rows: DataFrame, title: str, limit: int = 100) -> str:
    """A small table as Markdown; of more than ``limit`` rows the first, and a line that says that there are more.

    ``sources.text_sink.write_report`` writes tables of any size.
    """
    cell = lambda v: ("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    held = rows.limit(limit + 1).collect()
    more = [f"(more than {limit} rows)"] if len(held) > limit else []
    return "\n".join([*lines, *["| " + " | ".join(map(cell, r)) + " |" for r in held[:limit]], *more]) + "\n"


def linear_probe(train: DataFrame, test: DataFrame, features: str = "features", label: str = "label", rounds: int = 200) -> DataFrame:
    """``test`` with pred of a logistic regression on frozen features (arrays), rows of a class weighted by its rarity.

    With fewer than two classes every prediction is the only one.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("t"), F.count("*").alias("c"), F.min(label).alias("one")).first()
    if not total["t"] or total["c"] < 2:
        return test.withColumn("pred", F.lit(total["one"]))
    weight = F.lit(float(total["t"])) / (F.lit(float(total["c"])) * F.col("_n"))
    x = array_to_vector(F.col(features).cast("array<double>"))
    rows = train.join(F.broadcast(n), label).select(x.alias("x"), F.col(label).cast("double").alias("y"), weight.alias("w"))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=rounds, predictionCol="pred").fit(rows)
    return fitted.transform(test.withColumn("x", x)).drop("x", "rawPrediction", "probability").withColumn("pred", F.col("pred").cast("long"))


def probe_scores(predicted: DataFrame, label: str = "label") -> DataFrame:
    """One row: n, accuracy of ``pred``, and the accuracy of always saying the most frequent label."""
    top = predicted.groupBy(label).agg(F.count("*").alias("_k")).agg(F.max("_k").alias("top"))
    n = predicted.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("pred") == F.col(label)).cast("double")), F.lit(0.0)).alias("accuracy"))
    return n.crossJoin(top).select("n", "accuracy", F.coalesce(F.try_divide("top", "n"), F.lit(0.0)).alias("majority"))


def class_shares(spans: DataFrame) -> DataFrame:
    """label, n, percent of all spans."""
    n = spans.groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def counter(rows: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """key, n: the most frequent first, ties by the key; all or the first ``limit``."""
    n = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return n if limit is None else n.limit(limit)


def first_examples(rows: DataFrame, keys: list[str], order: list[str], k: int = 8) -> DataFrame:
    """The first k rows per ``keys`` in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order))
    if not keys:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")


def unique_surfaces(named: DataFrame) -> DataFrame:
    """label, surfaces: different surfaces in lower case."""
    return named.groupBy("label").agg(F.count_distinct(F.lower("surface")).alias("surfaces"))


def suffix_counts(named: DataFrame, k: int = 12) -> DataFrame:
    """label, suffix, n: the most frequent attached suffixes of each label."""
    n = named.withColumn("suffix", tx.surface_suffix(F.col("surface"))).filter("suffix <> ''").groupBy("label", "suffix").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "suffix"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def entity_scripts(named: DataFrame) -> DataFrame:
    return named.groupBy("label", tx.script_of(F.col("surface")).alias("script")).agg(F.count("*").alias("n"))


def label_totals(spans: DataFrame) -> DataFrame:
    """label (or ALL), docs, n: a rollup with its total."""
    rows = spans.withColumn("label", F.explode(F.array("label", F.lit("ALL"))))
    return rows.groupBy("label").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n"))


def suffix_selfcheck(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: how often the rewrite of span ends gets a stripped suffix back, and extends spans that have none.

    A suffix counts if over one character is left of the span; apostrophes before it go with it.
    """
    at = {c: F.col(c) - F.col("base") for c in ("start", "end")}
    rows = sp.in_context(spans, docs).withColumns(at).withColumnRenamed("ctx", "text")
    surface = F.lower(tx.slice_text(F.col("text"), F.col("start"), F.col("end")))
    suffix = F.lit("")
    for s in sorted(tx.SUFFIXES, key=lambda x: (len(x), x)):
        suffix = F.when((F.length(surface) > len(s) + 1) & F.endswith(surface, F.lit(s)), s).otherwise(suffix)
    rows = rows.withColumn("suffix", suffix)
    stem = F.regexp_replace(tx.slice_text(F.col("text"), F.col("start"), F.col("end") - F.length("suffix")), f"[{tx.APOSTROPHES}]+\\z", "")
    rows = rows.withColumn("cut", F.when(F.col("suffix") != "", F.col("start") + F.length(stem)).otherwise(F.col("end")))
    rows = rows.withColumn("r", tx.rewrite_span_end(F.col("text"), F.col("start"), F.col("cut")))
    has, back, grown = F.col("suffix") != "", (F.col("r.end") == F.col("end")) & (F.col("r.reason") == "extended"), F.col("r.reason") == "extended"
    return rows.agg(F.count("*").alias("entities"), F.count_if(has).alias("with_suffix"), F.count_if(has & back).alias("recovered"), F.count_if(~has).alias("without_suffix"), F.count_if(~has & grown).alias("false_extend"))


def text_sizes(text: str = "text") -> list[Column]:
    """words and chars of a text, 1 at least."""
    return [F.greatest(tx.word_count(F.col(text)), F.lit(1)).alias("words"), F.greatest(F.length(text), F.lit(1)).alias("chars")]


def tokens_per_word(rows: DataFrame, by: list[str], text: str = "text", n_tokens: str = "n_tok", sizes: tuple[str, str] | None = None) -> DataFrame:
    """by, n, mean tokens a word, mean tokens a character, texts of over 384 and 512 tokens with two special ones.

    ``sizes`` names columns that hold the ``text_sizes``, for rows that come without their texts.
    """
    n = F.greatest(F.col(n_tokens), F.lit(1))
    words, chars = map(F.col, sizes) if sizes else text_sizes(text)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(n / words).alias("per_word"), F.avg(n / chars).alias("per_char"), F.count_if(n + 2 > 384).alias("over_384"), F.count_if(n + 2 > 512).alias("over_512"))


def demo_records(rows: DataFrame, key: str, predicates: dict[str, Column]) -> DataFrame:
    """name, key: for each predicate in turn the first row that it holds for and that is not taken yet.

    Each step looks for one row only; there are few predicates.
    """
    spark, taken = rows.sparkSession, []
    for name, holds in predicates.items():
        left = rows.filter(holds)
        if taken:
            left = left.filter(~F.col(key).isin(*[t[1] for t in taken]))
        one = left.orderBy(key).select(key).first()
        if one:
            taken.append((name, one[key]))
    return spark.createDataFrame(taken, f"name string, {key} {rows.schema[key].dataType.simpleString()}")
