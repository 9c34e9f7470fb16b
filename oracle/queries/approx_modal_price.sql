WITH counts AS (
  SELECT s.article_id, s.unit_of_measure, s.shelf_price AS price, count(*) AS n FROM fx_store_article s JOIN fx_store t ON t.store_id = s.store_id
  WHERE s.is_store_active AND (s.is_new OR s.is_ranged) AND NOT t.is_metro_store AND NOT t.is_neighbourhood_store AND s.category NOT IN ('Brand#5', 'Brand#21')
    AND s.financial_week_end_date BETWEEN DATE '2001-08-05' - 7 * 103 AND DATE '2001-08-05' GROUP BY ALL),
totals AS (
  SELECT article_id, unit_of_measure, SUM(n)::BIGINT AS n_rows, max(n) AS top, min(price) AS least, max(price) AS most, CAST(floor(SUM(n) * 3.5 / 512) AS BIGINT) AS slack FROM counts GROUP BY ALL),
bounds AS (SELECT *, greatest(top - slack, 1) AS at_least, slack >= greatest(top - slack, 1) AS is_open FROM totals)
SELECT b.article_id, b.unit_of_measure, round(max(c.price) FILTER (WHERE c.n = b.top), 4) AS price, b.at_least, greatest(b.top, b.slack) AS at_most,
  round(CASE WHEN b.is_open THEN b.least ELSE min(c.price) FILTER (WHERE c.n >= b.at_least) END, 4) AS low,
  round(CASE WHEN b.is_open THEN b.most ELSE max(c.price) FILTER (WHERE c.n >= b.at_least) END, 4) AS high,
  b.is_open AS maybe_null, NOT b.is_open AND count(*) FILTER (WHERE c.n >= b.at_least) = 1 AS certain, b.n_rows AS "rows"
FROM bounds b JOIN counts c ON c.article_id = b.article_id AND c.unit_of_measure = b.unit_of_measure
GROUP BY b.article_id, b.unit_of_measure, b.at_least, b.top, b.slack, b.is_open, b.least, b.most, b.n_rows
