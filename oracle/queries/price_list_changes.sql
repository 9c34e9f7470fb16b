WITH banner AS (SELECT store_id FROM fx_store WHERE (contains(store_name, 'GreenCart') OR starts_with(store_name, 'ValueBarn')) AND NOT contains(store_name, 'Test')),
days AS (SELECT * FROM (VALUES (DATE '2001-07-03', 0), (DATE '2001-08-02', 1)) t(day, is_new)),
listed AS (
  SELECT * FROM (
    SELECT d.is_new, p.site, p.unit_of_measure, p.sell_price AS rrp, p.valid_to,
      row_number() OVER (PARTITION BY d.is_new, p.sales_org, p.site, p.article_id ORDER BY p.valid_to DESC, p.valid_from DESC, p.sell_price DESC, p.unit_of_measure DESC) AS rn
    FROM fx_price p JOIN days d ON p.valid_from <= d.day
    WHERE p.purchase_cost IS NOT NULL AND p.sales_org IN ('ORG1', 'ORG3') AND p.site IN (SELECT store_id FROM banner)) q WHERE rn = 1),
counts AS (SELECT site, unit_of_measure, rrp, valid_to, count(*) FILTER (WHERE is_new = 0) AS o, count(*) FILTER (WHERE is_new = 1) AS n FROM listed GROUP BY ALL)
SELECT site, unit_of_measure, round(rrp, 4) AS rrp, valid_to, CAST(greatest(o - n, 0) AS BIGINT) AS removed, CAST(greatest(n - o, 0) AS BIGINT) AS added, CAST(least(o, n) AS BIGINT) AS kept
FROM counts WHERE o <> n
