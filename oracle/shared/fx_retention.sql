SELECT s.offer_id, s.brand, count(*) AS brand_shoppers, count(*) FILTER (g.redeemer_type IS NULL) AS non_redeemers,
  count(*) FILTER (g.redeemer_type = 'New' AND p.scv_id IS NOT NULL) AS retained_new_to_brand_shoppers,
  count(*) FILTER (g.redeemer_type = 'Reactivated' AND p.scv_id IS NOT NULL) AS retained_reactivated_shoppers,
  count(*) FILTER (g.redeemer_type = 'Repeat' AND p.scv_id IS NOT NULL) AS retained_repeat_shoppers
FROM (SELECT DISTINCT offer_id, brand, scv_id FROM fx_sales WHERE in_campaign AND scv_id IS NOT NULL) s
LEFT JOIN fx_segment g ON g.offer_id = s.offer_id AND g.brand = s.brand AND g.scv_id = s.scv_id
LEFT JOIN (SELECT DISTINCT offer_id, brand, scv_id FROM fx_sales WHERE in_post AND scv_id IS NOT NULL) p ON p.offer_id = s.offer_id AND p.brand = s.brand AND p.scv_id = s.scv_id
GROUP BY s.offer_id, s.brand
