"""DuckDB statements for the queries of this folder that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         -ln((('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
         / coalesce(1.0 - 0.9::DOUBLE * (length(text) - length(regexp_replace(text, '[#*$%&|<>!]', '', 'g'))) / nullif(length(text), 0), 1.0) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sized GROUP BY source),
steps AS (
  SELECT *, w * (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER ahead, 0))
            > 3 * source_size * (sum(w) OVER () - coalesce(sum(w) OVER ahead, 0)) AS is_full
  FROM src WINDOW ahead AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN (3 * source_size)::DOUBLE
              ELSE (w * (sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0)))::DOUBLE
                   / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target
  FROM steps),
placed AS (
  SELECT s.*, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
cuts AS (
  SELECT source, max((key, doc_id)) AS cut FROM placed
  WHERE size > 0 AND 2 * (target - epochs * source_size - before) >= size GROUP BY source)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target,
       p.epochs + CASE WHEN c.cut IS NOT NULL AND (p.key, p.doc_id) <= c.cut THEN 1 ELSE 0 END AS copies,
       p.size * (p.epochs + CASE WHEN c.cut IS NOT NULL AND (p.key, p.doc_id) <= c.cut THEN 1 ELSE 0 END) AS taken
FROM placed p LEFT JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
"""


OP12 = """
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pairs AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.x, c.x), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM kept a JOIN kept c ON a.row <> c.row WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM pairs WHERE same
  QUALIFY place <= 5),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.id)::INT AS rank
  FROM positive p JOIN pairs n ON p.anchor = n.anchor AND NOT n.same
   AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


def op13(rounds: int = 10) -> str:
    """The rounds written out, each as the nearest centroid of every vector and the floored means."""
    def nearest(i: int) -> str:
        return f"""
near{i} AS MATERIALIZED (
  SELECT row, arg_min(number, d * 16 + number) AS number, min(d) AS d FROM (
    SELECT v.row, c.number,
           list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM vectors v, c{i} c) GROUP BY row)"""

    def means(i: int) -> str:
        return f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.number, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT number, list(m ORDER BY place) AS x FROM (
      SELECT number, place, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM (SELECT n.number, unnest(v.x) AS v, generate_subscripts(v.x, 1) AS place
            FROM near{i} n JOIN vectors v ON n.row = v.row) GROUP BY number, place) GROUP BY number) m
  ON c.number = m.number)"""

    steps = ",".join(f"{nearest(i)},{means(i)}" for i in range(rounds))
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS number, x
  FROM vectors QUALIFY number < 8),{steps},{nearest(rounds)}
SELECT v.vec_id, n.number::INT AS cluster, n.d AS distance,
       sum(n.d) OVER (PARTITION BY n.number)::BIGINT AS cluster_inertia, sum(n.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near{rounds} n JOIN vectors v ON n.row = v.row JOIN c{rounds} c ON c.number = n.number
"""


def statements() -> dict[str, str]:
    return {"op2_mix_sources": OP2, "op12_hard_negatives": OP12, "op13_centroid_clusters": op13()}
