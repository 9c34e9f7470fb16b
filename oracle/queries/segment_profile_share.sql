WITH cell AS (SELECT b.offer_id, b.brand, x.segment_group FROM (SELECT DISTINCT offer_id, brand FROM fx_redemption) b CROSS JOIN (SELECT DISTINCT segment_group FROM fx_customer WHERE segment_group IS NOT NULL) x),
num AS (SELECT g.offer_id, g.brand, c.segment_group, count(*) FILTER (redeemer_type = 'Repeat') AS a, count(*) FILTER (redeemer_type = 'Reactivated') AS b, count(*) FILTER (redeemer_type = 'New') AS n
  FROM fx_weekly_segment g JOIN fx_customer c ON c.scv_id = g.scv_id GROUP BY ALL),
filled AS (SELECT cell.*, coalesce(a, 0) AS repeat_customers, coalesce(b, 0) AS reactivated_customers, coalesce(n, 0) AS new_to_brand_customers
  FROM cell LEFT JOIN num ON num.offer_id = cell.offer_id AND num.brand = cell.brand AND num.segment_group = cell.segment_group),
total AS (SELECT *, CAST(SUM(repeat_customers) OVER w AS BIGINT) AS total_repeat, CAST(SUM(reactivated_customers) OVER w AS BIGINT) AS total_reactivated, CAST(SUM(new_to_brand_customers) OVER w AS BIGINT) AS total_new_to_brand
  FROM filled WINDOW w AS (PARTITION BY offer_id, brand))
SELECT *, round(repeat_customers / nullif(total_repeat, 0), 4) AS repeat_share, round(reactivated_customers / nullif(total_reactivated, 0), 4) AS reactivated_share,
  round(new_to_brand_customers / nullif(total_new_to_brand, 0), 4) AS new_to_brand_share FROM total
