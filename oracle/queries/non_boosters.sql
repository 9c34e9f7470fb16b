SELECT w.offer_id, w.brand, count(DISTINCT w.scv_id) AS non_boosters FROM fx_weekly_purchase w
WHERE w.in_campaign AND NOT EXISTS (SELECT 1 FROM fx_activation a WHERE a.offer_id = w.offer_id AND a.scv_id = w.scv_id) GROUP BY w.offer_id, w.brand
