"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks. With weight w (a share of all slots), block i of a
source is released at slot floor(i / w) and due by slot ceil((i + 1) / w); every slot
goes to a released block with the earliest deadline. While every source has blocks, each
source's number of blocks after any number of slots differs from its weight's share by
less than one block.

Weights are integer parts of a whole of ``sum(parts)`` slots, so the schedule repeats
after that many slots. Sources of equal parts are one class, whose blocks are those of its
members in turn; a block's window as one of the class lies within its window as one of
its member, so it is enough to schedule the few classes (ties: the class of fewer parts).
One period is laid out by a fold in SQL. Its first pass keeps only the state at every
``STRIDE``-th slot, the second lays out the stretches in between side by side.

Documents are numbered within their source in the order of the MD5 of doc_id, by a bucket
of that digest and a running sum over the buckets. All sources have the same buckets, so
that many that ``BUCKET_ROWS`` rows of all fall in one; rows are dealt by (source, bucket),
and no task sees a whole source. Places are running sums over the slots, in three levels.

When a source has run out, its slots are left empty and the others go on in the same
order, so every document gets exactly one place and none is dropped or repeated.

Defined cases: a null source is the source ``''``. Sources without a weight get
``default`` parts. Parts must be positive. Equal rows get places one after another. An
empty table gives an empty result. Further columns stay as they are, whatever their names,
but for those of the new ones, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import materialize

BLOCK = 8
BUCKET_ROWS = 4_000
STRIDE = 1_000
FAN = 1_024
#: integer parts of the production mix; a source that is not named has the default
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src5": 2, "src7": 2}
DEFAULT = 1


def period_schedule(classes: DataFrame, stride: int = STRIDE) -> DataFrame:
    """parts, period, turn (0 .. width - 1), slot of one period; classes: parts, width (slots a period).

    The fold's state is the number of slots each class has had; releases and deadlines
    follow from it in whole numbers. classes has a row for each distinct number of parts.
    """
    whole = classes.groupBy().agg(F.sort_array(F.collect_list(F.struct("parts", "width"))).alias("s"), F.sum("width").cast("long").alias("period")).filter("period > 0")
    choice = """array_min(transform(
        filter(sequence(0, size(s) - 1), k -> acc.done[k] < s[k].width and acc.done[k] * period div s[k].width <= t),
        k -> struct((acc.done[k] * period + period + s[k].width - 1) div s[k].width as due, k as k))).k"""
    # the choice is needed twice, so each step is a let-binding over a one-element array
    after = "transform(acc.done, (d, k) -> if(k = c, d + 1L, d))"
    marks = f"""
      aggregate(sequence(0L, period - 1),
        struct(transform(s, x -> 0L) as done, cast(array() as array<array<bigint>>) as marks),
        (acc, t) -> transform(array({choice}),
          c -> struct({after} as done, if(t % {stride} = 0, concat(acc.marks, array(acc.done)), acc.marks) as marks))[0],
        acc -> acc.marks)"""
    parts = whole.select("s", "period", F.posexplode(F.expr(marks)).alias("i", "done"))
    plan = f"""
      aggregate(sequence(i * {stride}L, least((i + 1) * {stride}L, period) - 1),
        struct(done as done, cast(array() as array<struct<k: int, turn: bigint>>) as plan),
        (acc, t) -> transform(array({choice}),
          c -> struct({after} as done, concat(acc.plan, array(struct(c as k, acc.done[c] as turn))) as plan))[0],
        acc -> acc.plan)"""
    laid = parts.repartition(F.col("i")).select("s", "period", "i", F.posexplode(F.expr(plan)).alias("j", "x"))
    return laid.select(F.expr("s[x.k].parts").alias("parts"), "period", F.col("x.turn").alias("turn"), (F.col("i") * stride + F.col("j")).cast("long").alias("slot"))


def numbered(rows: DataFrame, group: str, key: str, order: list[str], buckets: int, about: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``number``, from 0 within ``group``, in the order of the MD5 of ``key`` and of ``order``.

    Rows are dealt by group and bucket, a range of the digest, never by the group alone. The
    columns of ``about``, one row a group, reach the rows by way of the buckets.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = rows.withColumn("_digest", digest)
    rows = rows.withColumn("_bucket", (F.conv(F.left("_digest", F.lit(8)), 16, 10).cast("long") * buckets / (1 << 32)).cast("long"))
    dealt = rows.repartition(group, "_bucket")
    sizes = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if about is not None:
        starts = starts.join(about, group)
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_digest", *order)) - 1
    out = dealt.withColumn("_within", within).join(starts, [group, "_bucket"])
    return out.withColumn("number", F.col("_start") + F.col("_within")).drop("_digest", "_bucket", "_within", "_start")


def running_sum(sizes: DataFrame, key: str, levels: int = 3) -> DataFrame:
    """key, first: the sum of ``size`` over all smaller keys (keys are unique, not negative)."""
    if not levels:
        before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)  # keys / FAN ** 3
        return sizes.select(key, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    up = f"_up{levels}"
    dealt = sizes.withColumn(up, F.expr(f"{key} div {FAN}")).repartition(up)
    base = running_sum(dealt.groupBy(up).agg(F.sum("size").alias("size")), up, levels - 1).withColumnRenamed("first", "_base")
    before = Window.partitionBy(up).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("_in", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return inner.join(base, up).select(key, (F.col("_base") + F.col("_in")).alias("first"))


NEW = ["block", "release", "deadline", "slot", "position"]


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; rows that agree in it and in doc_id are copies."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c not in NEW])


def source_slots(sources: DataFrame, buckets: int) -> DataFrame:
    """source, parts, period, slots (of one period, in order); sources: source, parts."""
    members = numbered(sources, "parts", "source", ["source"], buckets)
    classes = members.groupBy("parts").agg(F.count("*").alias("members"))
    plan = period_schedule(classes.select("parts", (F.col("parts") * F.col("members")).alias("width")))
    plan = plan.join(classes, "parts").select("parts", "period", F.expr("turn % members").alias("number"), F.expr("turn div members").alias("turn"), "slot")
    held = plan.groupBy("parts", "number").agg(F.first("period").alias("period"), F.sort_array(F.collect_list("slot")).alias("slots"))
    return members.join(held, ["parts", "number"]).select("source", "parts", "period", "slots")


def places(docs: DataFrame, weights: dict[str, int] | None = None, default: int = DEFAULT, block: int = BLOCK, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, row_hash, block, release, deadline, slot and position of every row.

    position numbers all rows from 0 in the mixed order. Texts are only hashed: what is
    shuffled are these few numbers.
    """
    weights = WEIGHTS if weights is None else weights
    if default < 1 or any(w < 1 for w in weights.values()) or block < 1:
        raise ValueError("parts and block must be positive")
    rows = docs.select("doc_id", "source", row_hash(docs).alias("row_hash"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"))
    rows = materialize(rows, "mix-rows")
    buckets = max(1, -(-rows.count() // bucket_rows))
    named = F.create_map(*[F.lit(x) for k in weights.items() for x in k]) if weights else None
    parts = F.lit(default) if named is None else F.coalesce(F.try_element_at(named, F.col("source")), F.lit(default))
    sources = rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n")).select("source", parts.cast("long").alias("parts"))
    slots = materialize(source_slots(sources, buckets), "mix-sources").withColumnRenamed("source", "_source")
    rows = numbered(rows, "_source", "doc_id", ["doc_id", "row_hash"], buckets, slots).withColumn("block", F.expr(f"number div {block}"))
    rows = rows.withColumns({
        "slot": F.expr("block div parts * period + get(slots, cast(block % parts as int))"),
        "release": F.expr("block * period div parts"),
        "deadline": F.expr("(block * period + period + parts - 1) div parts"),
    })
    rows = materialize(rows.select("doc_id", "source", "row_hash", "number", "block", "release", "deadline", "slot"), "mix-numbers")
    first = running_sum(rows.groupBy("slot").agg(F.count("*").alias("size")), "slot")
    rows = rows.join(first, "slot").withColumn("position", F.col("first") + F.expr(f"number % {block}"))
    return rows.select("doc_id", "source", "row_hash", *NEW)


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, default: int = DEFAULT, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with block, release, deadline, slot and position.

    Whole rows are shuffled once, by (doc_id, row hash), to meet their places. Rows that agree
    in both are equal, so one of them stands for all, and each place takes a copy of it.
    """
    names = [c for c in docs.columns if c not in NEW]
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_id")
    at = places(docs, weights, default, block).select(key("doc_id"), F.col("row_hash").alias("_hash"), F.struct(*NEW).alias("_at"))
    rows = docs.select(key("doc_id"), row_hash(docs).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    one = rows.repartition("_id", "_hash").dropDuplicates(["_id", "_hash"])
    out = one.join(at, ["_id", "_hash"])
    return out.select(*[F.col(f"_row.`{c}`") for c in names], *[F.col(f"_at.{n}").alias(n) for n in NEW])
