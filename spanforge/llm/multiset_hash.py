"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A document is the multiset of its paragraphs (what stands between newlines; empty ones do
not count). A paragraph hashes to a wide vector of whole numbers, and the fingerprint is the
sum of the vectors, lane by lane, modulo 2**32. So the order of paragraphs does not matter,
and a paragraph is inserted or deleted by adding or subtracting its vector (``plus``,
``minus``), without the rest of the text. The lanes of a paragraph are

- one that counts its three-word sequences (words are what single blanks separate; a
  paragraph of fewer words is one sequence),
- ``EQUAL`` lanes of 32 bits from two SHA-256 digests of the whole paragraph: they tell
  multisets apart that are not equal,
- ``WIDE`` lanes that count, for each bit of the MD5 digests of its three-word sequences,
  how often it is set. Twice the count less the number of sequences is a sum of random signs,
  so the inner product of two fingerprints estimates how many sequences the two documents share.

``likeness`` is twice that product over the sum of both squares (0 if negative): 1 for equal
fingerprints, about the shared part for others, about 0 for unrelated texts, with a standard
error of about ``WIDE ** -0.5`` there.

All work is done by DataFrame functions. Lanes are sums in one hash aggregate, combined
before a shuffle, so at most a vector a text is shuffled. ``successors`` shuffles the texts
once, into bins of consecutive ids, and ``edits`` needs no other shuffle. Bins come from percentiles of the ids, each divided
evenly, so that their number follows the number of rows; ids that hold more than one part in
``PARTS`` of the rows, and null ids, are divided by text hash besides.

Defined cases: a null text counts as empty; an empty text has the zero fingerprint, which is
like itself (1) and unlike all others (0). Rows of one doc_id follow each other by the hash
of their texts, then by text; null ids come last. A document that is alone is its own
successor. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import materialize

EQUAL, WIDE = 16, 128
MASK = (1 << 32) - 1
PARTS, ROWS, MOST = 256, 500, 4096


def paragraphs(text: str) -> Column:
    return F.expr(rf"filter(split({text}, '\n', -1), p -> p <> '')")


def vectors(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and vector, the sum over all paragraphs of all texts with these keys."""
    rows = texts.select(*keys, F.explode_outer(paragraphs(text)).alias("p"))
    digest = F.concat(*[F.sha2(F.concat(F.lit(x), F.col("p")), 256) for x in "01"])
    rows = rows.select(*keys, "p", F.split("p", " ", -1).alias("w"), digest.alias("g"))
    sequences = F.expr("if(size(w) < 3, array(p), transform(sequence(0, size(w) - 3), i -> concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2))))")
    rows = rows.select(*keys, "g", F.posexplode_outer(sequences).alias("at", "s")).withColumn("m", F.md5("s"))
    half = lambda k: F.conv(F.substring("m", 1 + 16 * k, 16), 16, -10).cast("long")
    rows = rows.select(*keys, "g", "at", half(0).alias("lo"), half(1).alias("hi"))
    bit = lambda c, j: F.shiftright(c, j).bitwiseAND(1)
    equal = [F.coalesce(F.sum(F.when(F.col("at") == 0, F.conv(F.substring("g", 1 + 8 * i, 8), 16, 10).cast("long"))), F.lit(0)).alias(f"e{i}") for i in range(EQUAL)]
    # two lanes in one sum, 32 bits each
    wide = [F.coalesce(F.sum(bit("lo", j) + F.shiftleft(bit("hi", j), 32)), F.lit(0)).alias(f"c{j}") for j in range(WIDE // 2)]
    sums = rows.groupBy(*keys).agg(F.count("at").alias("n"), *equal, *wide)
    low, high = ([f(F.col(f"c{j}")) for j in range(WIDE // 2)] for f in (lambda c: c.bitwiseAND(MASK), lambda c: F.shiftright(c, 32)))
    lanes = [F.col("n"), *[F.col(f"e{i}").bitwiseAND(MASK) for i in range(EQUAL)], *low, *high]
    return sums.select(*keys, F.array(*lanes).alias("vector"))


def plus(a: str, b: str) -> Column:
    """The fingerprint of both multisets together."""
    return F.expr(f"zip_with({a}, {b}, (x, y) -> (x + y) & {MASK}L)")


def minus(a: str, b: str) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.expr(f"zip_with({a}, {b}, (x, y) -> (x - y) & {MASK}L)")


def likeness(a: str, b: str) -> Column:
    """0 to 1: the estimated share of common three-word sequences."""
    signs = lambda v: f"transform(slice({v}, {EQUAL + 2}, {WIDE}), x -> 2 * x - get({v}, 0))"
    dot = lambda x, y: f"aggregate(zip_with({signs(x)}, {signs(y)}, (x, y) -> x * y), 0L, (s, x) -> s + x)"
    squares = f"({dot(a, a)} + {dot(b, b)})"
    return F.expr(f"if({squares} = 0, 1D, greatest(2 * cast({dot(a, b)} as double) / {squares}, 0D))")


def digits(vector: str) -> Column:
    """The lanes as lowercase hex, eight digits each."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def bin_of(docs: DataFrame) -> Column:
    """A number of each row of ``docs`` (did, th): its bins, from the last to the first, hold the rows by descending did, then th."""
    at = [i / PARTS for i in range(PARTS)]
    stats = docs.agg(F.count("*").alias("n"), F.max("did").alias("most"), F.percentile_approx("did", at, 100 * PARTS).alias("cuts")).first()
    found = stats["cuts"] or []
    cuts = sorted(set(found))
    common = [c for c in cuts if found.count(c) > 1]
    subs = min(max(stats["n"] // (PARTS * ROWS), 1), MOST)
    split = F.shiftright("th", 56) + 128
    if not cuts:
        return -1 - split
    widths = [max(-(-(b - a) // subs), 1) for a, b in zip(cuts, [*cuts[1:], stats["most"] + 1], strict=True)]
    numbers = lambda x: F.array(*[F.lit(v).cast("long") for v in x])
    did = F.col("did")
    part = F.size(F.filter(numbers(cuts), lambda c: c <= did))
    sub = F.floor((did - F.get(numbers([cuts[0], *cuts]), part)) / F.get(numbers([1, *widths]), part))
    own = F.when(did.isin(common), split).otherwise(0) if common else F.lit(0)
    return F.when(did.isNull(), -1 - split).otherwise((part * (2 * MOST) + F.least(F.greatest(sub, F.lit(0)), F.lit(2 * MOST - 1))) * 256 + 255 - own).cast("long")


def successors(docs: DataFrame) -> DataFrame:
    """bin, k, uid, doc_id, text, next_uid, next_text: every document beside the next one by descending doc_id; the first follows the last.

    k counts the documents of a bin; the result is dealt by bin.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    # the same columns in every use, so that the exchange is planned once
    rows = rows.withColumn("bin", bin_of(rows)).repartition("bin")
    order = Window.partitionBy("bin").orderBy(F.col("did").desc_nulls_last(), "th", "text", "uid")
    placed = rows.withColumns({"k": F.row_number().over(order), "next": F.lead(F.struct("uid", "text")).over(order)})
    firsts = placed.filter("k = 1").select("bin", F.struct("uid", "text").alias("first"))
    # one row a bin
    bins = firsts.select("bin").withColumns({"after": F.lead("bin").over(Window.orderBy(F.desc("bin"))), "top": F.max("bin").over(Window.partitionBy())})
    edges = bins.select("bin", F.coalesce("after", "top").alias("to")).join(firsts.select(F.col("bin").alias("to"), "first"), "to").select("bin", "first")
    whole = placed.join(edges, "bin").withColumn("next", F.coalesce("next", "first"))
    return whole.select("bin", "k", "uid", F.col("did").alias("doc_id"), "text", F.col("next.uid").alias("next_uid"), F.col("next.text").alias("next_text"))


def exchanged(pairs: DataFrame) -> DataFrame:
    """``pairs`` (of ``successors``) with edited: the last half of the text replaced by as much of the next one's beginning.

    shared, own and new are the paragraphs that both texts begin with, the rest of the text,
    and the rest of the edited one; each paragraph is in one of them.
    """
    rows = pairs.withColumn("n", F.length("text")).withColumn("kept", F.expr("left(text, n - n div 2)"))
    rows = rows.withColumns({"edited": F.expr("concat(kept, left(next_text, n div 2))"), "same": F.expr(r"length(kept) - length(substring_index(kept, '\n', -1))")})
    return rows.withColumns({"shared": F.expr("left(text, same)"), "own": F.expr("substring(text, same + 1)"), "new": F.expr("substring(edited, same + 1)")})


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, vector, edited (vectors), near_edited, near_next of every document.

    The edited text is that of ``exchanged``; its fingerprint is the own one without the
    paragraphs that go and with those that come. The texts stay where ``successors`` has dealt
    them: a bin is part of every key, so vectors are summed, put together and compared with
    the next document's without another shuffle. Only the last document of a bin, whose next
    one lies in another, is compared afterwards: one row a bin.
    """
    rows = exchanged(successors(docs))
    keys = ["bin", "k", "uid", "next_uid", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(*keys[:5], F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("shared", "own", "new")).alias("part", "text"))
    parts = vectors(rows, [*keys, "part"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "vector"))).alias("p"))
    whole = parts.withColumn("vector", plus("p[0].vector", "p[1].vector"))
    whole = whole.withColumn("less", minus("vector", "p[1].vector")).withColumn("edited", plus("less", "p[2].vector")).drop("p", "less")
    whole = whole.withColumn("next", F.lead("vector").over(Window.partitionBy("bin").orderBy("k")))
    near = F.when(F.col("next").isNotNull(), likeness("vector", "next"))
    done = materialize(whole.withColumns({"near_edited": likeness("vector", "edited"), "near_next": near}).drop("next"), "multiset-hashes")
    firsts = done.filter("k = 1").select(F.col("uid").alias("next_uid"), F.col("vector").alias("next"))
    lasts = done.filter("near_next is null").join(firsts, "next_uid").withColumn("near_next", likeness("vector", "next"))
    columns = ["doc_id", "n_chars", "edited_sha256", "vector", "edited", "near_edited", "near_next"]
    return done.filter("near_next is not null").select(*columns).unionByName(lasts.select(*columns))
