WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3.0 * source_size AS ceiling,
         (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), targets AS (
  SELECT source, source_size, least(ceiling::DOUBLE, max(level) OVER () * weight) AS target FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets
), placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs,
         floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed
