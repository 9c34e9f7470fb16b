SELECT h.scv_id, h.store_id, n.site_id, round(n.distance_km, 4) AS distance_km
FROM (SELECT scv_id, CASE WHEN preferred_store_id = '28' AND main_store_id IS NULL THEN NULL ELSE preferred_store_id END AS store_id FROM fx_customer) h LEFT JOIN fx_nearest n ON n.store_id = h.store_id
