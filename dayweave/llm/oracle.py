"""The same queries in SQL, where it can express them."""

from __future__ import annotations

from dayweave.llm import mixing

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
         md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER o - 3 * source_size))::DOUBLE
            / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE AS level
  FROM sources
  WINDOW o AS (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source AS whose, source_size::BIGINT AS source_size,
         least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target
  FROM levels),
queue AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size
                             ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM sized),
served AS (SELECT * FROM queue JOIN targets ON source IS NOT DISTINCT FROM whose)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN target > 0 THEN (start + size) / target END AS finish,
       ({" + ".join(f"greatest(0, least(size, floor(target)::BIGINT - start - {k} * source_size))" for k in range(3))})::BIGINT AS taken
FROM served"""

# Positions that lie in a repeated window, per text; texts without one have no row.
_RULES = f"""split AS (
  SELECT doc_id, source, text, row_number() OVER () AS row_id,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
grams AS (
  SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
repeated AS (
  SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, gram) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT row_id, count(DISTINCT place) AS n
  FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY row_id),
rules AS (
  SELECT split.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (row_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rules),
hosts AS (
  SELECT source AS host, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f
  FROM judged WHERE source IS NOT NULL GROUP BY source),
sums AS (
  SELECT count(*) AS k, sum(n) AS docs, sum(f) / sum(n) AS m, sum(n * n) AS squares, sum(f * f / n) AS rates FROM hosts),
moments AS (
  SELECT m, CASE WHEN k >= 2 AND m * (1 - m) > 0 THEN (rates - docs * m * m) / (m * (1 - m)) - (k - 1) END AS excess,
         docs - squares / docs - (k - 1) AS scale FROM sums),
prior AS (
  SELECT m, CASE WHEN excess > 0 AND scale > 0 THEN greatest(scale / excess - 1, 1) END AS weight
  FROM moments),
bad AS (
  SELECT host FROM hosts CROSS JOIN prior
  WHERE CASE WHEN weight IS NULL THEN m ELSE (f + weight * m) / (n + weight) END > 0.5),
verdicts AS (
  SELECT judged.*, NOT base_failed AND host IS NULL AS kept FROM judged LEFT JOIN bad ON source = host)"""

OP9 = f"""WITH {_RULES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP3 = f"""WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (
  SELECT page_id, payload, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS holder FROM payloads),
quads AS (
  SELECT *, list_transform(range(8), lambda i: ('0x' || substr(digest, CAST(5 * i + 1 AS INTEGER), 5))::BIGINT) AS q FROM hashed)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda j:
         substr('{_BASE32}', CAST((q[j // 4 + 1] >> (15 - 5 * (j % 4))) % 32 + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM quads"""


def _components(before: str, nodes: str, edges: str, wanted: str) -> str:
    """`wanted` over reach(node, component); `edges` has both directions."""
    return f"""WITH RECURSIVE {before},
walk(node, other) AS (
  SELECT node, node FROM ({nodes})
  UNION
  SELECT walk.node, b FROM walk JOIN ({edges}) ON walk.other = a),
reach AS (SELECT node, min(other) AS component FROM walk GROUP BY node)
{wanted}"""


OP7 = _components(
    """valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93)""",
    "SELECT vec_id AS node FROM embeddings",
    "SELECT a, b FROM links",
    """SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, component AS component_id,
       node = component AS kept
FROM reach""",
)

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingle_links(source: str, words: int, percent: int) -> str:
    return f"""split AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM {source}),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {words - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM split WHERE len(w) > 0)),
sizes AS MATERIALIZED (
  SELECT split.doc_id, count(s)::BIGINT AS n FROM split LEFT JOIN shingles USING (doc_id) GROUP BY split.doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y USING (s)
    WHERE x.doc_id <> y.doc_id GROUP BY a, b)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= {percent} * (p.n + q.n - shared))"""


OP8 = _components(
    _shingle_links("documents", 4, 85),
    "SELECT doc_id AS node FROM documents",
    "SELECT a, b FROM links",
    """SELECT node AS doc_id, n AS n_shingles, component AS component_id
FROM reach JOIN sizes ON doc_id = node""",
)

OP10 = """WITH bytes AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
starts AS (
  SELECT doc_id, i, substr(hex(t), CAST(2 * i + 1 AS INTEGER), 100) AS s
  FROM (SELECT doc_id, t, unnest(range(octet_length(t) - 49)) AS i FROM bytes WHERE octet_length(t) >= 50)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM starts) WHERE least < doc_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS fresh
  FROM late WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a AS edge, lag(b, 1, 0) OVER o AS from_, a AS to_ FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL
  SELECT doc_id, max(octet_length(t)), max(coalesce(b, 0)), max(octet_length(t))
  FROM bytes LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(hex(t), CAST(2 * from_ + 1 AS INTEGER), CAST(2 * (to_ - from_) AS INTEGER)), '' ORDER BY from_, to_) AS h
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(h)) AS kept_sha256
FROM bytes JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id) USING (doc_id)"""

OP11 = """WITH vectors AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""

ORACLE = {
    "op1_mix": OP1,
    "op3_warc": OP3,
    "op7_embedding_links": OP7,
    "op8_ngram_join": OP8,
    "op9_quality": OP9,
    "op10_suffix_dedup": OP10,
    "op11_hard_negatives": OP11,
}
