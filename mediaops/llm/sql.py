"""SQL twins, for DuckDB, of the corpus queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality_rules(documents: str = "documents", share: float = 0.01, least: int = 3, depleted: float = 0.7) -> str:
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM {documents}
), worded AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '{WORD}') AS w FROM base
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM worded)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), lines AS (
  SELECT r, source, text, line, translate(array_to_string(regexp_extract_all(line, '{WORD}'), ' '), '{_UPPER}', '{_LOWER}') AS norm,
         len(regexp_extract_all(line, '{WORD}')) AS words
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM base)
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE words > 0 GROUP BY r
), hosts AS (
  SELECT source, count(DISTINCT text) AS texts FROM lines WHERE words > 0 GROUP BY source
), spread AS (
  SELECT source, norm, count(DISTINCT text) AS in_texts FROM lines WHERE words > 0 GROUP BY source, norm
), common AS (
  SELECT s.source, s.norm FROM spread s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source
  WHERE s.in_texts > {least} AND s.in_texts > CAST({share} AS DOUBLE) * h.texts
), lost AS (
  SELECT l.r, CAST(sum(l.words) AS BIGINT) AS n FROM lines l
  JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY l.r
), measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
  FROM worded LEFT JOIN repeated USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT *, NOT base_failed AND n_removed_words <= CAST({depleted} AS DOUBLE) * n_words AS kept FROM judged"""


def vector_search() -> str:
    return """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


def lexical_search() -> str:
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents
), sized AS (
  SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM docs WHERE len(t) > 0
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized
), asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest({terms}) AS t FROM (SELECT item_id, max(text) AS text FROM benchmark GROUP BY item_id)
  ) GROUP BY item_id, t
), held AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM sized) WHERE t IN (SELECT t FROM asked) GROUP BY r, t
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, corpus GROUP BY t, docs
), scored AS (
  SELECT a.item_id, s.r, s.doc_id,
         CAST(sum(a.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (75 + (25 * s.n * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM held h JOIN asked a USING (t) JOIN weights w USING (t) JOIN sized s ON s.r = h.r, corpus c GROUP BY a.item_id, s.r, s.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality_rules(), "op10_vector_search": vector_search(), "op12_lexical_search": lexical_search()}
