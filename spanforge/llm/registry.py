"""The queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import block_max, byte_cnn, language_id, line_winnow, link_trust, merkle_paths, multiset_hash, pfair_mix, piece_bpe, posting_ann, simhash_bk, threshold_topk, toxicity
from spanforge.llm.common import ascii_lower, at_random, fold_of, table


def labelled(spark: SparkSession, sf_dir: str, label: str, max_docs: int, train: Column | None = None) -> DataFrame:
    """doc_id, text, label of at most ``max_docs`` labelled documents for which ``train`` holds.

    They are chosen by a hash of doc_id among the labels alone; the chosen ids, a bounded
    number, are then broadcast, so no text is shuffled.
    """
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label")).filter(F.col("label").isNotNull())
    chosen = at_random("doc_id", max_docs, rows if train is None else rows.filter(train))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def op1_posting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_ann.search(table(spark, sf_dir, "embeddings"))


def op2_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"), piece_bpe.load())


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.search(table(spark, sf_dir, "embeddings"))


def op4_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(table(spark, sf_dir, "pages"))


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of("doc_id", 3) == 1
    model = toxicity.train(labelled(spark, sf_dir, "toxic", toxicity.MAX_TRAIN_DOCS, ~held_out))
    scored = toxicity.score(table(spark, sf_dir, "documents"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pfair_mix.places(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "block", "release", "deadline", "slot", "position")


def op7_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of("doc_id", 3) == 1
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs, ~held_out)
    return language_id.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_bk.hex_of(F.col("fp")[0]).alias("fingerprint"), "component_id")


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of("doc_id", 5) == 0
    model = byte_cnn.train(labelled(spark, sf_dir, "quality", byte_cnn.MAX_TRAIN_DOCS, ~held_out))
    scored = byte_cnn.score(table(spark, sf_dir, "documents"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_winnow.dedup_lines(table(spark, sf_dir, "documents"), native=True)
    return cut.select("doc_id", "n_deleted", F.md5("text").alias("text_md5"))


def op11_merkle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    entries = merkle_paths.manifest(table(spark, sf_dir, "documents"), {"text": ascii_lower(F.col("text"))}, tampered)
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return merkle_paths.proofs(entries).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = block_max.build(table(spark, sf_dir, "documents"))
    return block_max.search(index, table(spark, sf_dir, "benchmark"))


def op13_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = multiset_hash.edits(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", "edited_sha256", multiset_hash.digits("vector").alias("fingerprint"), multiset_hash.digits("edited").alias("edited_fingerprint"), "near_edited", "near_next")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_posting_ann, op2_piece_dropout, op3_threshold_topk, op4_link_trust, op5_weak_toxicity, op6_pfair_mix, op7_rank_order_language, op8_simhash_bktree, op9_byte_cnn, op10_line_winnow, op11_merkle_paths, op12_block_max, op13_multiset_hash]
    return {f.__name__: f for f in own}


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
c AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS vec_id, CAST(sum(q.x * e.x) AS BIGINT) AS score
  FROM c q JOIN c e ON q.d = e.d WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6_SQL = """
WITH RECURSIVE src AS (SELECT coalesce(source, '') AS s, {parts} AS parts FROM documents GROUP BY 1, 2),
cls AS (SELECT parts, count(*) AS c, parts * count(*) AS width FROM src GROUP BY 1),
cfg AS (SELECT list(CAST(width AS BIGINT) ORDER BY parts) AS w, CAST(sum(width) AS BIGINT) AS p FROM cls),
sim AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS turn FROM cfg
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: CASE WHEN i = c THEN d + 1 ELSE d END), c, done[c] FROM (
    SELECT t, done, list_sort(list_filter(list_transform(w, lambda x, i: CASE WHEN done[i] < x AND done[i] * p // x <= t THEN struct_pack(due := (done[i] * p + p + x - 1) // x, i := i) END), lambda z: z IS NOT NULL))[1].i AS c
    FROM sim, cfg WHERE t < p)),
k AS (SELECT parts, c, row_number() OVER (ORDER BY parts) AS pick FROM cls),
plan AS (SELECT parts, turn % c AS member, turn // c AS r, t - 1 AS slot FROM sim JOIN k USING (pick) WHERE t > 0),
mem AS (SELECT s, parts, row_number() OVER (PARTITION BY parts ORDER BY md5(s), s) - 1 AS member FROM src),
d AS (SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS n FROM documents),
b AS (SELECT doc_id, source, parts, n, n // 8 AS block, (n // 8) // parts * p + slot AS slot, p FROM d JOIN mem USING (s) JOIN plan USING (parts, member), cfg WHERE plan.r = (n // 8) % parts)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(block * p // parts AS BIGINT) AS release, CAST((block * p + p + parts - 1) // parts AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot,
       CAST(row_number() OVER (ORDER BY slot, n % 8) - 1 AS BIGINT) AS position FROM b
""".format(parts="CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in pfair_mix.WEIGHTS.items()) + f" ELSE {pfair_mix.DEFAULT} END")

#: by the definition: what stands in a run of 50 words that stood earlier goes
OP10_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*') AS t FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS k FROM d WHERE len(t) > 0),
w AS (SELECT doc_id, list(rtrim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) ORDER BY k) AS w FROM tok GROUP BY 1),
g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS k, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' ')))) AS h FROM w WHERE len(w) >= 50),
late AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM late),
kept AS (SELECT tok.doc_id, count(gone.k) AS n_deleted, coalesce(string_agg(CASE WHEN gone.k IS NULL THEN x END, '' ORDER BY tok.k), '') AS rest FROM tok LEFT JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_deleted, 0) AS INTEGER) AS n_deleted, md5(CASE WHEN coalesce(n_deleted, 0) = 0 THEN text ELSE regexp_extract(text, '^[ \t\n\x0B\f\r]*') || rest END) AS text_md5
FROM documents LEFT JOIN kept USING (doc_id)
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")) + ")"


def _merkle_sql(levels: int) -> str:
    """Trees of up to 8 ** ``levels`` documents a lang, level by level: every node beside its siblings.

    A row a document goes up with idx (of its ancestor), own (hash of its ancestor), fold and
    proof so far; the nodes of a level are the distinct ancestors.
    """
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        "WITH bits AS (SELECT CAST(range AS UINTEGER) AS b FROM range(256)), "
        + "s0 AS (SELECT b, b AS c FROM bits), "
        + ", ".join(f"s{k + 1} AS (SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END AS c FROM s{k})" for k in range(8)),
        "steps AS (SELECT list(c ORDER BY b) AS t FROM s8)",
        "d AS (SELECT row_number() OVER () AS rid, * FROM documents)",
        "crc AS (SELECT rid, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UINTEGER))), lambda a, x: xor(t[CAST(xor(a, x) & 255 AS INTEGER) + 1], a >> 8)), 4294967295::UINTEGER) AS crc FROM d, steps)",
        f"l AS (SELECT rid, doc_id, lang, {_LEAF.format(text='text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {_LEAF.format(text=lower)} ELSE {_LEAF.format(text='text')} END AS start FROM d LEFT JOIN crc USING (rid))",
        "u0 AS (SELECT rid, doc_id, leaf, lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, leaf AS own, start AS fold, '' AS proof FROM l)",
    ]

    def rise(a: str, b: str) -> list[str]:
        """``b``: the rows of ``a`` one level up; those whose tree has one node left stay."""
        return [
            f"{a}n AS (SELECT DISTINCT tree, idx, n, own FROM {a} WHERE n > 1)",
            f"{a}p AS (SELECT tree, idx // 8 AS up, string_agg(own, '' ORDER BY idx) AS pre, list(own ORDER BY idx) AS kids FROM {a}n GROUP BY 1, 2)",
            f"{b} AS (SELECT rid, doc_id, leaf, a.tree, CASE WHEN n > 1 THEN idx // 8 ELSE idx END AS idx, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n, CASE WHEN n > 1 THEN sha256(pre) ELSE own END AS own, "
            f"CASE WHEN n > 1 THEN sha256(array_to_string(list_transform(kids, lambda h, i: CASE WHEN i - 1 = idx % 8 THEN fold ELSE h END), '')) ELSE fold END AS fold, "
            f"CASE WHEN n > 1 THEN proof || array_to_string(list_filter(kids, lambda h, i: i - 1 <> idx % 8), '') ELSE proof END AS proof "
            f"FROM {a} a LEFT JOIN {a}p p ON p.tree IS NOT DISTINCT FROM a.tree AND p.up = a.idx // 8)",
        ]

    for k in range(levels):
        parts += rise(f"u{k}", f"u{k + 1}")
    parts.append("r AS (SELECT tree, dense_rank() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx FROM (SELECT DISTINCT tree FROM u0))")
    parts.append(f"t0 AS (SELECT rid, doc_id, leaf, own AS subroot, 0 AS tree, r.idx, (SELECT count(*) FROM r) AS n, own, fold, proof FROM u{levels} u JOIN r ON r.tree IS NOT DISTINCT FROM u.tree)")
    for k in range(3):
        parts += [x.replace("SELECT rid, doc_id, leaf, a.tree", "SELECT rid, doc_id, leaf, subroot, a.tree") for x in rise(f"t{k}", f"t{k + 1}")]
    return ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, own AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = own AS verified FROM t3"


OP11_SQL = _merkle_sql(7)

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + block_max.TERMS + "')"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
p AS (SELECT rid, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term), c GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

_HEX = "CAST('0x' || substr({x}, {a}, {n}) AS UBIGINT)"


def _multiset_sql(equal: int, wide: int) -> str:
    lane = lambda i: f"sum({_HEX.format(x='g', a=1 + 8 * i, n=8)}) % 4294967296"
    half = wide // 2
    bits = ", ".join(f"sum(({c} >> {j}) & 1)" for c in ("lo", "hi") for j in range(half))
    dot = "list_sum(list_transform(list_zip(a.l, {b}.l), lambda z: CAST((2 * z[1] - a.n) * (2 * z[2] - {b}.n) AS HUGEINT)))"
    own = "list_sum(list_transform({a}.l, lambda x: CAST((2 * x - {a}.n) * (2 * x - {a}.n) AS HUGEINT)))"
    near = lambda b: f"CASE WHEN {own.format(a='a')} + {own.format(a=b)} = 0 THEN 1 ELSE greatest(2 * CAST({dot.format(b=b)} AS DOUBLE) / CAST({own.format(a='a')} + {own.format(a=b)} AS DOUBLE), 0) END"
    digits = lambda a: f"array_to_string(list_transform(list_concat([{a}.n], {a}.e, {a}.l), lambda x: printf('%08x', x)), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, length(text) AS n, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS k, count(*) OVER () AS c FROM d),
x AS (SELECT a.k, a.k % a.c + 1 AS nk, a.doc_id, a.n, a.text, left(a.text, a.n - a.n // 2) || left(b.text, a.n // 2) AS edited FROM o a JOIN o b ON b.k = a.k % a.c + 1),
t AS (SELECT k, 0 AS v, text FROM x UNION ALL SELECT k, 1, edited FROM x),
p AS (SELECT k, v, p FROM (SELECT k, v, unnest(string_split(text, chr(10))) AS p FROM t) WHERE p <> ''),
g AS (SELECT k, v, sha256('0' || p) || sha256('1' || p) AS g FROM p),
e AS (SELECT k, v, [{", ".join(map(lane, range(equal)))}] AS e FROM g GROUP BY 1, 2),
w AS (SELECT k, v, p, string_split(p, ' ') AS w FROM p),
s AS (SELECT k, v, md5(unnest(CASE WHEN len(w) < 3 THEN [p] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS m FROM w),
m AS (SELECT k, v, {_HEX.format(x="m", a=1, n=16)} AS lo, {_HEX.format(x="m", a=17, n=16)} AS hi FROM s),
l AS (SELECT k, v, count(*) AS n, [{bits}] AS l FROM m GROUP BY 1, 2),
f AS (SELECT k, v, CAST(coalesce(l.n, 0) AS BIGINT) AS n, CAST(coalesce(e, list_transform(range({equal}), lambda i: 0)) AS BIGINT[]) AS e, CAST(coalesce(l, list_transform(range({wide}), lambda i: 0)) AS BIGINT[]) AS l FROM t LEFT JOIN l USING (k, v) LEFT JOIN e USING (k, v))
SELECT doc_id, CAST(x.n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {digits("a")} AS fingerprint, {digits("b")} AS edited_fingerprint, {near("b")} AS near_edited, {near("y")} AS near_next
FROM x JOIN f a ON a.k = x.k AND a.v = 0 JOIN f b ON b.k = x.k AND b.v = 1 JOIN f y ON y.k = x.nk AND y.v = 0
"""


OP13_SQL = _multiset_sql(multiset_hash.EQUAL, multiset_hash.WIDE)


def oracle_sql() -> dict[str, str]:
    return {"op3_threshold_topk": OP3_SQL, "op6_pfair_mix": OP6_SQL, "op10_line_winnow": OP10_SQL, "op11_merkle_paths": OP11_SQL, "op12_block_max": OP12_SQL, "op13_multiset_hash": OP13_SQL}
