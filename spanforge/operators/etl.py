"""Conversion, leakage removal, de-duplication, mixing and sampling of annotated sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import gazetteer as gz
from spanforge.operators import spans as sp
from spanforge.sources.shared import written

# fixed values: the sources' entity types and ours
MENTION_MAP = {"PERSON": "NAME", "PER": "NAME", "ORG": "ORG", "LOC": "GEO", "GPE": "GEO", "FAC": "GEO", "FACILITY": "GEO"}
SPAN_MAP = {"PER": "NAME", "ORG": "ORG", "GPE": "GEO", "LOC": "GEO"}
TOKEN_MAP = {"PER": "NAME", "ORG": "ORG", "LOC": "GEO"}


def mapped(kind: Column, mapping: dict[str, str]) -> Column:
    """Our label of a source's type, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), kind)


def map_counts(kinds: DataFrame, kind: str, mapping: dict[str, str]) -> DataFrame:
    """label (null: rejected), n, keep_share of the raw types."""
    n = kinds.groupBy(mapped(F.col(kind), mapping).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def mention_spans(docs: DataFrame, mapping: dict[str, str] = MENTION_MAP) -> DataFrame:
    """Spans of mention lists; docs: doc_id, text, ner map<string, array<string>>.

    Mentions are trimmed; empty ones and ``nan`` are dropped, mentions with several labels
    are conflicts and dropped, and every hit at a word's start counts.
    """
    listed = docs.select("doc_id", F.explode("ner").alias("kind", "mentions")).select("doc_id", mapped(F.col("kind"), mapping).alias("label"), F.explode("mentions").alias("mention"))
    listed = listed.withColumn("mention", F.trim("mention")).filter("label is not null and mention <> '' and lower(mention) <> 'nan'")
    clear = listed.groupBy("doc_id", "mention").agg(F.count_distinct("label").alias("k"), F.min("label").alias("label")).filter("k = 1")
    hits = clear.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "label", "mention", tx.locate_mention(F.col("text"), F.col("mention")).alias("hit"))
    return hits.select("doc_id", "label", F.explode("hit.starts").alias("start"), F.length("mention").alias("n")).select("doc_id", "label", "start", (F.col("start") + F.col("n")).alias("end"))


def is_synthetic(meta: Column) -> Column:
    return F.coalesce(meta["is_synthetic"], F.lit(False)) | (F.lower(F.coalesce(meta["source_tier"], F.lit(""))) == "synthetic")


def span_source(rows: DataFrame, mapping: dict[str, str] = SPAN_MAP) -> DataFrame:
    """Spans of records (doc_id, text, entities, meta): real ones, of known types, whose claimed text agrees."""
    real = rows.filter(~F.coalesce(is_synthetic(F.col("meta")), F.lit(False)))
    each = sp.contexts(real, "entities", "doc_id").withColumnRenamed("x", "e")
    claimed = F.col("e.text")
    good = (F.col("e.start") >= 0) & (F.col("e.start") < F.col("e.end")) & (F.col("e.end") <= F.col("n"))
    each = each.filter(good & (claimed.isNull() | (claimed == tx.slice_text(F.col("ctx"), F.col("e.start") - F.col("base"), F.col("e.end") - F.col("base")))))
    return each.select("doc_id", mapped(F.col("e.label"), mapping).alias("label"), F.col("e.start").alias("start"), F.col("e.end").alias("end")).filter("label is not null")


def token_source(rows: DataFrame, mapping: dict[str, str] = TOKEN_MAP) -> DataFrame:
    """Spans of token rows (doc_id, ord, token, tag): text put together, runs of one mapped label.

    A type without a label ends a run; an I of the same label goes on, whatever its raw type.
    """
    placed = sp.detokenize(rows, "doc_id", "ord", "token").join(rows.select("doc_id", "ord", "tag"), ["doc_id", "ord"])
    label = mapped(tx.tag_type(F.col("tag")), mapping)
    tagged = placed.withColumn("tag", F.when(label.isNull(), "O").otherwise(F.concat(F.when(F.upper("tag").startswith("B"), "B-").otherwise("I-"), label)))
    return sp.decode_bio(tagged.select("doc_id", "ord", "start", "end", "tag"), end="last", labels=None)


def finalize(spans: DataFrame, docs: DataFrame, rewrite: bool = True) -> DataFrame:
    """Spans with attached suffixes, without outer blanks, made flat."""
    rows = sp.in_context(spans, docs)
    start, end = (F.col(c) - F.col("base") for c in ("start", "end"))
    to = tx.rewrite_span_end(F.col("ctx"), start, end)["end"] if rewrite else end
    rows = rows.withColumn("to", F.explode(F.array(to)))  # so that it is worked out once
    rows = rows.filter(tx.slice_text(F.col("ctx"), start, F.col("to")).rlike(rf"^[^{tx.WHITE}](?:[\s\S]*[^{tx.WHITE}])?\z"))
    return sp.select_flat(rows.select("doc_id", "label", "start", (F.col("to") + F.col("base")).alias("end")), sp.FLAT_PRIORITY)


def canonical(spans: DataFrame) -> DataFrame:
    """doc_id, entities: sorted by start, end, label."""
    order = F.sort_array(F.collect_list(F.struct("start", "end", "label")))
    return spans.groupBy("doc_id").agg(F.transform(order, lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end"))).alias("entities"))


def finalized_records(spans: DataFrame, docs: DataFrame, source: str, rewrite: bool = True) -> DataFrame:
    """hash, doc_id, text, entities of the records that keep a span."""
    held = canonical(finalize(spans, docs, rewrite))
    return docs.select("doc_id", "text").join(held, "doc_id").select(tx.record_hash(F.lit(source), F.col("doc_id"), F.col("text")).alias("hash"), "doc_id", "text", "entities")


#: bits of a filter for each official text, and the most that one filter may have (16 MB)
BITS_A_TEXT, MOST_BITS = 10, 1 << 27
_BUCKET = 1 << 15  # bits of one bitmap


def text_digest(text: Column) -> Column:
    """The SHA-256 of the normal form: what stands for a text in shuffles."""
    return F.sha2(tx.normalize_text(text), 256)


def bloom_filter(digests: DataFrame, bits: int) -> DataFrame:
    """One row: a Bloom filter of the column ``d`` with three places a digest, as an array of bitmaps.

    The bitmaps are built by an aggregate, so only set bits are shuffled, and none twice from one task.
    """
    places = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.pmod(F.xxhash64("d", i), F.lit(bits)))
    held = digests.select(F.explode(places).alias("at")).groupBy(F.expr(f"at div {_BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("bitmap"))
    every = digests.sparkSession.range(bits // _BUCKET).withColumnRenamed("id", "bucket").join(held, "bucket", "left")
    order = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("bitmap", F.lit(bytearray())).alias("bitmap"))))
    return every.agg(F.transform(order, lambda x: x["bitmap"]).alias("bits"))


def may_hold(bits: int) -> Column:
    """Whether the filter in column ``bits`` may hold the digest ``d``."""

    def one(i: int) -> Column:
        at = F.pmod(F.xxhash64("d", F.lit(i)), F.lit(bits))
        octet = F.substring(F.get("bits", (at / _BUCKET).cast("int")), ((at % _BUCKET) / 8).cast("int") + 1, F.lit(1))
        return F.coalesce(F.conv(F.hex(octet), 16, 10).cast("int"), F.lit(0)).bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0

    return one(0) & one(1) & one(2)


def leak_flags(rows: DataFrame, official: DataFrame) -> DataFrame:
    """``rows`` (with text) with d (digest) and leak: whether the text's normal form is that of an official one.

    Equal texts have equal normal forms, so this is the whole test. A Bloom filter of the
    official texts lets nearly all others pass where they are read; the rest, the candidates,
    meet the official texts by digest and are compared in full. So what is shuffled is official
    texts and candidates, and no text is a key. A filter holds ``MOST_BITS`` at most (further
    official texts make it let through more candidates, never fewer leaks).
    """
    own = rows.withColumn("d", text_digest(F.col("text")))
    known = official.filter(F.col("text").isNotNull()).select(text_digest(F.col("text")).alias("d"), tx.normalize_text(F.col("text")).alias("_norm"))
    n = known.count()
    bits = _BUCKET
    while bits < min(n * BITS_A_TEXT, MOST_BITS):
        bits *= 2
    seen = own.crossJoin(F.broadcast(bloom_filter(known.select("d"), bits))).withColumn("_may", F.coalesce(may_hold(bits), F.lit(False))).drop("bits")
    texts = known.groupBy("d").agg(F.first("_norm").alias("_norm"), F.lit(True).alias("_hit"))
    met = seen.filter("_may").join(texts, "d", "left").withColumn("leak", F.coalesce(F.col("_hit") & (F.col("_norm") == tx.normalize_text(F.col("text"))), F.lit(False)))
    columns = [*rows.columns, "d", "leak"]
    return seen.filter("not _may").withColumn("leak", F.lit(False)).select(*columns).unionByName(met.select(*columns))


def drop_leaks(rows: DataFrame, official: DataFrame) -> DataFrame:
    """``rows`` (of those with a text) without texts that equal an official text, as they are or in normal form."""
    return leak_flags(rows.filter(F.col("text").isNotNull()), official).filter("not leak").select(*rows.columns)


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``: an aggregate, so that a common key is combined before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def conservation(rows: DataFrame, official: DataFrame) -> DataFrame:
    """source, docs_in, official, cross_source, kept; the last three add up to the first.

    Of the rows of one normal form the first by (source, doc_id) is kept; rows without a text
    are not. Rows are counted by digest and source, so a text that many rows share is as many
    rows as it has sources.
    """
    n = leak_flags(rows.select("source", "doc_id", "text"), official).groupBy("d", "source", "leak").agg(F.count("*").alias("n"))
    first = F.min("source").over(Window.partitionBy("d", "leak")) == F.col("source")
    kept = F.when(~F.col("leak") & F.col("d").isNotNull() & first, 1).otherwise(0)
    n = n.withColumn("kept", kept).groupBy("source").agg(F.sum("n").alias("docs_in"), F.sum(F.when(F.col("leak"), F.col("n")).otherwise(0)).alias("official"), F.sum("kept").alias("kept"))
    return n.select("source", "docs_in", "official", (F.col("docs_in") - F.col("official") - F.col("kept")).alias("cross_source"), "kept")


def write_kept(rows: DataFrame, official: DataFrame, path: str, sources: list[str]) -> list[dict]:
    """Writes the rows that ``conservation`` keeps, and returns its counters: they come with the write, not from a second scan.

    rows: source, doc_id, text and more. ``sources`` are those to be counted; the counters of
    any other are not asked for, but its rows are written too.
    """
    seen, left = Observation(), Observation()
    count = lambda name, ok: [F.count_if((F.col("source") == s) & ok).alias(f"{name}_{i}") for i, s in enumerate(sources)]
    flagged = leak_flags(rows, official).observe(seen, F.count("*").alias("all"), *count("in", F.lit(True)), *count("official", F.col("leak")))
    kept = first_wins(flagged.filter("not leak and d is not null"), "d", ["source", "doc_id"]).select(*rows.columns)
    kept.observe(left, F.count("*").alias("all"), *count("kept", F.lit(True))).write.mode("overwrite").parquet(path)
    a, b = seen.get, left.get
    out = []
    for i, s in enumerate(sources):
        n, gone, stay = a[f"in_{i}"], a[f"official_{i}"], b[f"kept_{i}"]
        out.append({"source": s, "docs_in": n, "official": gone, "cross_source": n - gone - stay, "kept": stay})
    return out


def seeded_order(key: Column, seed: int) -> Column:
    """A text whose order is a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def folds(keys: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """key, fold: round robin over the seeded order.

    The rank comes from counts of the first hash digits and a rank within them, so no task
    orders all keys.
    """
    if k < 2:
        raise ValueError("at least two folds")
    rows = keys.select(key).distinct().withColumn("h", seeded_order(F.col(key), seed)).withColumn("head", F.substring("h", 1, 3))
    sizes = rows.groupBy("head").agg(F.count("*").alias("n"))
    base = sizes.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("base"))  # 4096 rows at most
    within = F.row_number().over(Window.partitionBy("head").orderBy("h", key)) - 1
    return rows.withColumn("w", within).join(base, "head").select(key, ((F.col("base") + F.col("w")) % k).cast("int").alias("fold"))


def mix(gold: DataFrame, extra: DataFrame, key: str, cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Gold and at most ``cap`` extra rows, ``at`` giving the order of the shuffled mix, and the counts of both and of skipped ones."""
    fresh = extra.join(gold.select(key).distinct(), key, "left_anti")
    taken = fresh.orderBy(seeded_order(F.col(key), seed), key).limit(cap)
    out = gold.withColumn("part", F.lit("gold")).unionByName(taken.withColumn("part", F.lit("extra"))).withColumn("at", seeded_order(F.col(key), seed + 1))
    skipped = extra.join(gold.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("skipped"))
    n = out.agg(F.count_if(F.col("part") == "gold").alias("gold"), F.count_if(F.col("part") == "extra").alias("extra"), F.count("*").alias("total"))
    return out, n.crossJoin(skipped)


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def gazetteer_spans(docs: DataFrame, lexicon: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """Flat hits of a lexicon anywhere in a text: longer surfaces first, then the lexicon's order, then earlier hits.

    A lexicon is a list of (surface, label), or rows of surface, label and k, by which they are
    ordered. It is joined to the hits by surface: what is joined is hits, not texts.
    """
    if isinstance(lexicon, list):
        rows = [(s, label, k) for k, (s, label) in enumerate(lexicon)]
        lexicon = docs.sparkSession.createDataFrame(rows, "surface string, label string, k int")
    lexicon = written(lexicon.filter(F.col("label").isin(*sp.PRIORITY) & (F.col("surface") != "")), "lexicon")  # read twice
    hits = gz.lexicon_hits(docs, lexicon)
    rows = hits.join(lexicon.select("surface", "label", "k"), "surface").select("doc_id", "label", "k", "start", "end")
    return sp.select_flat(rows, order=("k", "start"))
