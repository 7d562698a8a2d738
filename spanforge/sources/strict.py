"""A strict scan of JSON-lines records: every rule in one pass, and the file and line of what breaks one.

Spark's reader cuts files at newlines into blocks and reads them in parallel, in any store that
it can open. A line's number is the number of lines in the blocks before its own and its place
in its block; what is kept of a block is one row (its lines, and its first line that breaks a
rule), so the scan is one aggregate. Repeated hashes are found by a second one over hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import text as tx

LABELS = ("ORG", "NAME", "GEO")
PLACE = ("path", "block", "at")


def located_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and path, block, at: the file, the offset at which its block begins, and a number that grows with the lines of a block."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _entities() -> Column:
    """label, start, end of the entities of the line, with what their values are."""
    kind = lambda c: f"schema_of_variant(try_variant_get(e, '$.{c}', 'variant'))"
    label = f"if({kind('label')} = 'STRING', try_variant_get(e, '$.label', 'string'), null) as label"
    numbers = ", ".join(f"try_variant_get(e, '$.{c}', 'bigint') as {c}" for c in ("start", "end"))
    whole = f"coalesce({kind('start')} = 'BIGINT' and {kind('end')} = 'BIGINT', false) as whole"
    return F.expr(f"transform(try_variant_get(v, '$.entities', 'array<variant>'), e -> struct({label}, {numbers}, {whole}, coalesce(schema_of_variant(e) like 'OBJECT%', false) as object))")


def _entity_problem() -> Column:
    """The first entity that breaks a rule, and which; else whether two of them overlap."""
    known = ", ".join(f"'{x}'" for x in LABELS)
    broken = f"""transform(ents, (e, i) -> case when not e.object then concat('entity ', i, ' is not an object') when not coalesce(e.label in ({known}), false) then concat('entity ', i, ' has no known label')
      when not coalesce(e.whole and 0 <= e.start and e.start < e.end and e.end <= length(t), false) then concat('entity ', i, ' has bad offsets')
      when twice and exists(slice(ents, 1, i), o -> o.label = e.label and o.start = e.start and o.end = e.end) then concat('entity ', i, ' is repeated') end)"""
    overlap = "exists(sequence(1, size(sorted)), i -> coalesce(get(sorted, i - 1).end > get(sorted, i).start, false))"
    return F.expr(f"coalesce(get(filter({broken}, p -> p is not null), 0), if(size(sorted) > 1 and {overlap}, 'overlapping entities', null))")


def problem_of(require_entities: bool = True) -> Column:
    """The first rule that the line ``value`` breaks, or null: the kind, and for entities which one and what."""
    kind = lambda c: f"schema_of_variant(try_variant_get(v, '$.{c}', 'variant'))"
    text, entities = F.expr(f"coalesce({kind('text')} = 'STRING', false)"), F.expr(f"coalesce({kind('entities')} like 'ARRAY%', false)")
    out = F.when(F.col("value").rlike(rf"^[{tx.WHITE}]*\z"), "blank line").when(F.expr("not coalesce(schema_of_variant(v) like 'OBJECT%', false)"), "bad json").when(F.expr(f"not coalesce({kind('hash')} = 'STRING' and h <> '', false)"), "no hash")
    if not require_entities:
        return out.when(~text & F.expr(f"{kind('text')} is not null"), "no text").when(~entities & F.expr(f"{kind('entities')} is not null"), "no entities")
    return out.when(~text, "no text").when(~entities, "no entities").otherwise(_entity_problem())


def judged(lines: DataFrame, require_entities: bool = True) -> DataFrame:
    """``lines`` with h (its hash) and problem."""
    rows = lines.withColumn("v", F.expr("try_parse_json(value)"))
    rows = rows.withColumns({"h": F.expr("try_variant_get(v, '$.hash', 'string')"), "t": F.expr("try_variant_get(v, '$.text', 'string')"), "ents": _entities()})
    rows = rows.withColumns({"twice": F.expr("size(array_distinct(ents)) < size(ents)"), "sorted": F.expr("array_sort(transform(ents, e -> struct(e.start, e.end, e.label)))")})
    return rows.withColumn("problem", problem_of(require_entities)).drop("v", "t", "ents", "twice", "sorted")


def block_starts(rows: DataFrame) -> DataFrame:
    """path, block, base (lines of the file before the block), first (``at`` of its first line), n, and found: its first problem."""
    found = F.min(F.when(F.col("problem").isNotNull(), F.struct("at", "problem")))
    blocks = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"), found.alias("found"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def repeated(rows: DataFrame) -> DataFrame:
    """path, block, at, h of the second line of every hash that has more than one."""
    place = Window.partitionBy("h").orderBy(*PLACE)
    return rows.filter("problem is null").select("h", *PLACE).withColumn("k", F.row_number().over(place)).filter("k = 2").drop("k")


def first_problem(spark: SparkSession, path: str, require_entities: bool = True, limit: int | None = None) -> str | None:
    """``file:line: problem`` of the first line (by file and line) that breaks a rule, or None.

    With ``limit`` only that many lines are read and judged.
    """
    lines = located_lines(spark, path)
    rows = judged(lines if limit is None else lines.limit(limit), require_entities)
    blocks = block_starts(rows)
    line = lambda at: (F.col("base") + F.col(at) - F.col("first") + 1).alias("line")
    bad = blocks.filter("found is not null").select("path", line("found.at"), F.col("found.problem").alias("problem"))
    twice = repeated(rows).groupBy("path", "block").agg(F.min(F.struct("at", "h")).alias("r")).join(blocks, ["path", "block"])
    bad = bad.unionByName(twice.select("path", line("r.at"), F.concat(F.lit("duplicate hash "), F.col("r.h")).alias("problem")))
    # one row a block, of which the first goes to the driver
    got = bad.orderBy("path", "line").limit(1).collect()
    if got:
        return f"{got[0]['path']}:{got[0]['line']}: {got[0]['problem']}"
    return None if blocks.limit(1).count() else f"{path}: no records"
