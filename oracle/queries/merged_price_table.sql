WITH priced AS (SELECT *, valid_from < DATE '2001-01-01' AS early FROM fx_price WHERE purchase_cost IS NOT NULL),
listed AS (
  SELECT * FROM (
    SELECT sales_org, site, article_id, sell_price AS rrp, valid_from, valid_to, early,
      row_number() OVER (PARTITION BY sales_org, site, article_id, early ORDER BY valid_to DESC, valid_from DESC, sell_price DESC) AS rn FROM priced) q WHERE rn = 1)
SELECT sales_org, site, article_id, round(rrp, 4) AS rrp, valid_from, valid_to FROM listed a
WHERE (NOT early AND valid_to >= DATE '2001-08-02')
   OR (early AND NOT EXISTS (SELECT 1 FROM listed b WHERE NOT b.early AND b.sales_org = a.sales_org AND b.site = a.site AND b.article_id = a.article_id))
