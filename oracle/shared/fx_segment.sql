SELECT r.offer_id, r.brand, r.scv_id,
  CASE WHEN EXISTS (SELECT 1 FROM fx_sales s WHERE s.offer_id = r.offer_id AND s.brand = r.brand AND s.scv_id = r.scv_id AND s.in_recent) THEN 'Repeat'
       WHEN EXISTS (SELECT 1 FROM fx_sales s WHERE s.offer_id = r.offer_id AND s.brand = r.brand AND s.scv_id = r.scv_id AND s.in_long) THEN 'Reactivated' ELSE 'New' END AS redeemer_type
FROM fx_redeemer r
