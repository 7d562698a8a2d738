"""A Merkle manifest of a table of documents, with parent-preimage paths.

Every row is a leaf, the hash of its fields. The leaves of one ``lang`` in order of doc_id
are a tree: every ``ARITY`` consecutive nodes, concatenated, hash to their parent, until one
is left, the subroot. The subroots in order of lang are a tree of the same kind, whose top is
the root. A hash is lowercase hex SHA-256, so each takes ``WIDTH`` characters.

What is stored is one row a parent: the *preimage*, that is the concatenated hashes of its
children. A leaf meets the preimages of all its ancestors in one row, and everything else is
cut out of them: the siblings at a level are the preimage without the leaf's own slot, and
a fold puts the hash so far into the slot and hashes the whole. So a proof needs no rows of
siblings, and a changed leaf can be folded up beside the original ones.

At scale: leaves are narrow rows (ids and hashes), the texts are read once and not shuffled.
Places in the order come from ``numbered``, so no task orders a whole lang. Levels shrink by
``ARITY`` and are written one by one; preimages are put together from the top down, so the
leaves themselves take part in one join (with an eighth as many parents) however high the
trees are. A parent has ``ARITY`` children, so no key is hot. The table of langs is
broadcast up to ``MANY`` rows; beyond, it is joined by lang and a salt.

Defined cases: null fields count as ``-``, null langs are a tree of their own, which comes
first; null doc_ids come first within a lang; rows of one doc_id are ordered by their leaves,
so exact repeats are leaves of their own with equal hashes. A lone leaf is its subroot, a
lone subroot the root, and the proof of a table of one row is the hash of nothing. An empty
table gives an empty manifest. Missing columns are an error; further ones are not hashed and
do not come along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, numbered

ARITY, WIDTH = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MANY, SALTS = 100_000, 64


def leaf_of(values: dict[str, Column]) -> Column:
    """The hash of ``values``: of each its UTF-8 length, a colon and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """lang, doc_id, leaf, and other: the leaf with the fields ``changed``, where ``when`` holds (else null)."""
    own = {c: F.col(f"`{c}`") for c in FIELDS}
    other = F.lit(None).cast("string") if changed is None else F.when(F.lit(True) if when is None else when, leaf_of(own | changed))
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("doc_id"), leaf_of(own).alias("leaf"), other.alias("other"))


def with_tree(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """``rows`` with the columns of their lang's row in ``trees``."""
    right = trees.withColumnRenamed("lang", "_lang")
    if trees.count() <= MANY:
        return rows.join(F.broadcast(right), rows["lang"].eqNullSafe(right["_lang"])).drop("_lang")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("_own", (F.col("position") % SALTS).cast("int"))
    return left.join(right, left["lang"].eqNullSafe(right["_lang"]) & (left["_own"] == right["_salt"])).drop("_lang", "_own", "_salt")


def parents(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, idx, n, hash), lowest first: tree, idx, n, preimage, hash.

    n is the number of nodes of the tree at the level; a tree ends where it is one.
    """
    out: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        children = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        up = nodes.filter("n > 1").groupBy("tree", F.expr(f"idx div {ARITY}").alias("idx"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
        level = up.agg(F.array_join(F.transform(children, lambda x: x["hash"]), "").alias("preimage"))
        nodes = materialize(level.withColumn("hash", F.sha2("preimage", 256)), f"{name}-{len(out) + 1}")
        out.append(nodes)
        most = -(-most // ARITY)
    return out


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, hash of the node that is left of each tree."""
    out = None
    for level in (nodes, *levels):
        one = level.filter("n = 1").select("tree", "hash")
        out = one if out is None else out.unionByName(one)
    return out


def ancestors(levels: list[DataFrame]) -> DataFrame | None:
    """tree, idx, path of the parents of leaves: the preimages from their own up to their tree's top."""
    out = None
    for level in reversed(levels):
        own = level.select("tree", "idx", F.array("preimage").alias("path"))
        if out is not None:
            up = out.select("tree", F.col("idx").alias("_up"), F.col("path").alias("_rest"))
            own = own.withColumn("_up", F.expr(f"idx div {ARITY}")).join(up, ["tree", "_up"], "left")
            own = own.select("tree", "idx", F.concat("path", F.coalesce("_rest", F.slice("path", 1, 0))).alias("path"))
        out = own
    return out


def slots(position: str, path: str) -> Column:
    """The slot of a leaf's ancestor in each preimage of ``path``."""
    return F.expr(f"transform({path}, (p, i) -> cast(shiftright({position}, 3 * i) & {ARITY - 1} as int))")


def siblings(path: str, own: str) -> Column:
    """Of each preimage what is left without the own slot."""
    return F.expr(f"zip_with({path}, {own}, (p, s) -> concat(left(p, {WIDTH} * s), substring(p, {WIDTH} * s + {WIDTH + 1}, {WIDTH * ARITY})))")


def fold(start: str, path: str, own: str) -> Column:
    """The root that ``start`` leads to: put into its slot of each preimage in turn, and hashed with it."""
    return F.expr(f"aggregate(zip_with({path}, {own}, (p, s) -> struct(p, s)), {start}, (h, x) -> sha2(overlay(x.p placing h from {WIDTH} * x.s + 1 for {WIDTH}), 256))")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """doc_id, lang, position (in its lang), leaf, other, subroot, root, path (preimages, bottom to top), slots.

    ``other`` is the leaf with the fields ``changed`` where ``when`` holds, else null.
    """
    rows = numbered(leaves(docs, changed, when), [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")], "leaves")
    langs = rows.groupBy("lang").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    trees = numbered(langs, [F.col("lang").asc_nulls_first()], "trees").withColumnRenamed("position", "tree")
    rows = with_tree(rows, trees).select("lang", "doc_id", "leaf", "other", "tree", (F.col("position") - F.col("first")).alias("idx"), "n")
    levels = parents(rows.select("tree", "idx", "n", F.col("leaf").alias("hash")), "parents")
    subroots = materialize(tops(rows.select("tree", "n", F.col("leaf").alias("hash")), levels), "subroots")
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash").withColumn("n", F.lit(subroots.count()).cast("long"))
    above = parents(upper, "upper")
    root = tops(upper, above).select(F.col("hash").alias("root"))  # one row
    none = F.array().cast("array<string>")
    over = ancestors(above)
    highest = subroots.select("tree", F.col("hash").alias("subroot"), F.expr(f"tree div {ARITY}").alias("_up"))
    highest = highest.withColumn("high", none) if over is None else highest.join(over.select(F.col("idx").alias("_up"), F.col("path").alias("high")), "_up", "left")
    of_tree = trees.select("lang", "tree").join(highest.drop("_up"), "tree").crossJoin(F.broadcast(root)).withColumn("high_slots", slots("tree", "high"))
    below = ancestors(levels)
    rows = rows.withColumn("_up", F.expr(f"idx div {ARITY}"))
    rows = rows.withColumn("path", none) if below is None else rows.join(below.withColumnRenamed("idx", "_up"), ["tree", "_up"], "left")
    rows = rows.select("lang", "doc_id", "leaf", "other", F.col("idx").alias("position"), F.coalesce("path", none).alias("low"))
    done = with_tree(rows, of_tree.drop("tree")).withColumn("low_slots", slots("position", "low"))
    return done.select("doc_id", "lang", "position", "leaf", "other", "subroot", "root", F.concat("low", "high").alias("path"), F.concat("low_slots", "high_slots").alias("slots"))


def proofs(entries: DataFrame) -> DataFrame:
    """``entries`` of a manifest with siblings (of each level, left to right) and folded_root, from ``other`` where there is one."""
    rows = entries.withColumns({"siblings": siblings("path", "slots"), "start": F.coalesce("other", "leaf")})
    return rows.withColumn("folded_root", fold("start", "path", "slots")).drop("start")

