"""Views of the SQL counterparts, as common table expressions."""

TOK = r"""
pieces AS (
  SELECT doc_id, unnest(p) AS surface, generate_subscripts(p, 1) - 1 AS ord
  FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]') AS p FROM documents)),
tok AS (
  SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(s AS BIGINT) AS s, CAST(s + length(surface) AS BIGINT) AS e, surface
  FROM (SELECT *, coalesce(sum(length(surface) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pieces)
  WHERE surface <> '')"""

SPANS = (
    TOK
    + r""",
lead AS (SELECT *, length(regexp_extract(surface, '^\p{Lu}\p{L}+')) AS n FROM tok),
gold AS (
  SELECT doc_id, CASE n % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'NAME' ELSE 'GEO' END AS label, s, CAST(s + n AS BIGINT) AS e FROM lead WHERE n > 0),
moved AS (SELECT *, (doc_id * 31 + s) % 10 AS r FROM gold),
pred AS (
  SELECT doc_id,
    CASE WHEN r IN (1, 4) THEN CASE label WHEN 'ORG' THEN 'NAME' WHEN 'NAME' THEN 'GEO' ELSE 'ORG' END ELSE label END AS label,
    CASE WHEN r = 3 AND e - s > 2 THEN s + 1 ELSE s END AS s,
    CASE WHEN r IN (2, 4) AND e - s > 2 THEN e - 1 ELSE e END AS e
  FROM moved WHERE r <> 0
  UNION ALL
  SELECT doc_id, 'GEO', s, e FROM lead WHERE n = 0 AND length(surface) >= 4 AND (doc_id * 17 + s) % 40 = 7),
sides AS (
  SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.label, p.label) AS label, coalesce(g.s, p.s) AS s, coalesce(g.e, p.e) AS e,
         CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS g, CASE WHEN p.doc_id IS NULL THEN 0 ELSE 1 END AS p
  FROM (SELECT DISTINCT * FROM gold) g FULL JOIN (SELECT DISTINCT * FROM pred) p
    ON g.doc_id = p.doc_id AND g.label = p.label AND g.s = p.s AND g.e = p.e),
dim(label) AS (VALUES ('ORG'), ('NAME'), ('GEO'))"""
)

PRF = """
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision_, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall_"""

F1 = "CASE WHEN precision_ + recall_ = 0 THEN 0 ELSE 2 * precision_ * recall_ / (precision_ + recall_) END"

COUNTS = "CAST(coalesce(sum(g * p), 0) AS BIGINT) AS tp, CAST(coalesce(sum(p * (1 - g)), 0) AS BIGINT) AS fp, CAST(coalesce(sum(g * (1 - p)), 0) AS BIGINT) AS fn"


def fold(source: str, conflict: str) -> str:
    """Greedy choice over the list ``arr`` of each row of ``source``, best first."""
    return f"""
  SELECT doc_id, unnest(list_reduce(list_transform(arr, lambda v: [v]), lambda acc, y:
    CASE WHEN len(list_filter(acc, lambda a: {conflict.replace("x.", "y[1].")})) > 0 THEN acc ELSE list_concat(acc, y) END)) AS v
  FROM {source}"""


RUNS = f"""
run_counts AS (SELECT d.source, {COUNTS} FROM sides JOIN documents d USING (doc_id) GROUP BY 1),
run_prf AS (SELECT *, {PRF}, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS n FROM run_counts),
runs AS (
  SELECT source AS run_id, 'm"' || (n % 3) AS model, 'dev' AS split,
    CASE WHEN n % 7 = 3 THEN 'unknown' ELSE '2024-01-' || lpad(CAST(n % 27 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END AS created_at,
    precision_, recall_, {F1} AS f1, tp, fp, fn FROM run_prf)"""

#: what Python calls white space, as the inside of a character class
WHITE = "\\t-\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"

NORM = f"""trim(regexp_replace(replace(lower(translate(text, 'ʼʻ‘’`´', '''''''''''''')), 'ß', 'ss'), '[{WHITE}]+', ' ', 'g'))"""

PROBS = """
z AS (SELECT vec_id AS id, label AS gold, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS z FROM embeddings),
ex AS (SELECT *, exp((z - max(z) OVER (PARTITION BY id)) / {t}) AS e FROM z),
pr AS (SELECT id, gold, k, e / sum(e) OVER (PARTITION BY id) AS p FROM ex),
one AS (
  SELECT id, gold, max(p) AS conf, CAST(arg_max(k, struct_pack(a := p, b := -k)) AS BIGINT) AS pred, max(CASE WHEN k = gold THEN p END) AS p_gold,
         sum((p - CASE WHEN k = gold THEN 1 ELSE 0 END) ** 2) AS brier
  FROM pr GROUP BY id, gold)"""
