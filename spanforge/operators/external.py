"""Profiles of annotated sources from elsewhere: what they hold, and how much of it we could use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import etl
from spanforge.operators import profile as pf
from spanforge.operators import spans as sp

# fixed values: type map, and the types that name a person
LEGAL_MAP = {"PER": "NAME", "ORG": "ORG", "LOC": "GEO"}
PERSON_TYPES = ("NAME", "PER", "PERSON", "FIO")


def mapped_share(kinds: DataFrame, kind: str, mapping: dict[str, str]) -> DataFrame:
    """One row: entities, kept (with a label of ours), dropped, keep_percent."""
    kept = F.count_if(etl.mapped(F.col(kind), mapping).isNotNull())
    n = kinds.agg(F.count(kind).alias("entities"), kept.alias("kept"))
    return n.select("entities", "kept", (F.col("entities") - F.col("kept")).alias("dropped"), F.coalesce(F.try_divide(F.col("kept") * 100.0, F.col("entities")), F.lit(0.0)).alias("keep_percent"))


def _entities(records: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """doc_id, kind, label, surface, start, end and context (ctx, base, n) of records (doc_id, text, entities of label, start, end, text)."""
    each = sp.contexts(records, "entities", "doc_id").withColumnRenamed("x", "e")
    surface = F.coalesce(F.when(F.col("e.text") != "", F.col("e.text")), tx.slice_text(F.col("ctx"), F.col("e.start") - F.col("base"), F.col("e.end") - F.col("base")), F.lit(""))
    return each.select("doc_id", F.col("e.label").alias("kind"), etl.mapped(F.col("e.label"), mapping).alias("label"), F.explode(F.array(surface)).alias("surface"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), "ctx", "base", "n")


def known_surfaces(found: DataFrame, official: DataFrame) -> DataFrame:
    """label, ours, theirs, both, either, jaccard, recall of mapped surfaces against official ones (label, surface)."""
    mine = found.filter("label is not null and surface <> ''").select("label", F.lower("surface").alias("surface"))
    return pf.surface_overlap(official.select("label", F.lower("surface").alias("surface")), mine)


def span_records(records: DataFrame, mapping: dict[str, str] = etl.SPAN_MAP) -> DataFrame:
    """One row: docs, with_entities, synthetic, latin, cyrillic, mixed, other, entities, with_suffix, facilities, kept, keep_percent."""
    script = tx.script_of(F.coalesce("text", F.lit("")))
    docs = records.agg(
        F.count("*").alias("docs"), F.count_if(F.size("entities") > 0).alias("with_entities"), F.count_if(F.coalesce(etl.is_synthetic(F.col("meta")), F.lit(False))).alias("synthetic"),
        *[F.count_if(script == x).alias(x) for x in ("latin", "cyrillic", "mixed", "other")],
    )
    found = _entities(records, mapping)
    rest = found.agg(F.count_if(tx.surface_suffix(F.col("surface")) != "").alias("with_suffix"), F.count_if(F.col("kind") == "FAC").alias("facilities"))
    return docs.crossJoin(mapped_share(found, "kind", mapping)).crossJoin(rest)


def token_rows(rows: DataFrame, mapping: dict[str, str] = etl.TOKEN_MAP) -> DataFrame:
    """One row: tokens, sentences, entities (tags with a type), kept, dropped, keep_percent; rows: sentence, tag."""
    kinds = rows.select(tx.tag_type(F.col("tag")).alias("kind"))
    return rows.agg(F.count("*").alias("tokens"), F.count_distinct("sentence").alias("sentences")).crossJoin(mapped_share(kinds, "kind", mapping))


def mention_records(docs: DataFrame, mapping: dict[str, str] = etl.MENTION_MAP, limit: int | None = None) -> DataFrame:
    """One row: docs, with_mentions, entities, kept, dropped, keep_percent; docs: doc_id, ner map<string, array<string>>."""
    rows = docs if limit is None else docs.orderBy("doc_id").limit(limit)
    each = rows.select("doc_id", F.explode("ner").alias("kind", "mentions")).select("doc_id", "kind", F.explode("mentions").alias("m")).filter("m is not null and trim(m) <> '' and lower(trim(m)) <> 'nan'")
    n = rows.agg(F.count("*").alias("docs")).crossJoin(each.agg(F.count_distinct("doc_id").alias("with_mentions")))
    return n.crossJoin(mapped_share(each, "kind", mapping))


def tag_ids(rows: DataFrame, names: list[str]) -> DataFrame:
    """tag, n of rows with an array ``tags`` of numbers into ``names``; a number without a name is itself."""
    each = rows.select(F.explode("tags").alias("k"))
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), (F.col("k") + 1).cast("int")), F.col("k").cast("string"))
    return pf.counter(each.select(F.when(F.col("k") < 0, F.col("k").cast("string")).otherwise(name).alias("tag")), "tag")


def splits(parts: dict[str, DataFrame]) -> DataFrame:
    """split, rows of several parts, as one union."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("split"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("split").agg(F.count("*").alias("rows"))


def typed_records(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: seen, with_person, mentions, person_percent of rows with an array ``types``."""
    rows = rows if limit is None else rows.orderBy("doc_id").limit(limit)
    types = F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.upper(t))
    person = lambda t: t.isin(*PERSON_TYPES)
    rows = rows.select(types.alias("t"))
    n = rows.agg(F.count("*").alias("seen"), F.count_if(F.exists("t", person)).alias("with_person"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("mentions"), F.coalesce(F.sum(F.size(F.filter("t", person))), F.lit(0)).alias("p"))
    return n.select("seen", "with_person", "mentions", F.round(F.col("p") * 100.0 / F.greatest("mentions", F.lit(1)), 2).alias("person_percent"))


def tag_rows(rows: DataFrame) -> DataFrame:
    """One row: tokens, docs and tagged tokens of rows (doc_id, tag)."""
    return rows.agg(F.count("*").alias("tokens"), F.count_distinct("doc_id").alias("docs"), F.count(tx.tag_type(F.col("tag"))).alias("tagged"))


def outside_suffixes(records: DataFrame, mapping: dict[str, str] = LEGAL_MAP, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Counters of records, and the first k spans that leave an attached suffix outside: doc_id, start, surface, context."""
    found = _entities(records, mapping)
    start, end = (F.col(c) - F.col("base") for c in ("start", "end"))
    longer = F.concat("surface", F.substring("ctx", end + 1, F.lit(4)))
    seen = F.struct((tx.surface_suffix(F.col("surface")) != "").alias("inside"), (tx.surface_suffix(longer) != "").alias("longer"))
    found = found.withColumn("s", F.explode(F.array(seen)))  # so that suffixes are looked up once
    left = (F.col("end") < F.col("n")) & F.col("s.longer") & ~F.col("s.inside")
    kept = F.count_if(F.col("label").isNotNull())
    # all counters of the spans in one pass
    of = found.agg(F.count("kind").alias("entities"), kept.alias("kept"), F.count_if("s.inside").alias("with_suffix"), F.count_if(left).alias("left_outside"))
    of = of.select("entities", "kept", (F.col("entities") - F.col("kept")).alias("dropped"), F.coalesce(F.try_divide(F.col("kept") * 100.0, F.col("entities")), F.lit(0.0)).alias("keep_percent"), "with_suffix", "left_outside")
    n = records.agg(F.count("*").alias("docs"), F.count_if(F.size("entities") > 0).alias("with_entities")).crossJoin(of)
    some = found.filter(left).select("doc_id", "start", "surface", tx.slice_text(F.col("ctx"), start, F.least(F.col("end") + 6, F.col("n")) - F.col("base")).alias("context"))
    return n, pf.first_examples(some, [], ["doc_id", "start"], k)


def status_rows(rows: DataFrame, mapping: dict[str, str], limit: int | None = None) -> DataFrame:
    """One row: seen, without_span (start or end null or empty), entities, kept, dropped, keep_percent; rows: label, status, start, end as text."""
    rows = rows if limit is None else rows.orderBy("row_id").limit(limit)
    missing = F.nullif("start", F.lit("")).isNull() | F.nullif("end", F.lit("")).isNull()
    return rows.agg(F.count("*").alias("seen"), F.count_if(missing).alias("without_span")).crossJoin(mapped_share(rows.filter("coalesce(label, '') <> ''"), "label", mapping))

