SELECT r.offer_id, r.brand, r.scv_id,
  CASE WHEN bool_or(w.in_recent) THEN 'Repeat' WHEN bool_or(w.in_long) THEN 'Reactivated' ELSE 'New' END AS redeemer_type
FROM fx_redeemer r LEFT JOIN fx_weekly_purchase w ON w.offer_id = r.offer_id AND w.brand = r.brand AND w.scv_id = r.scv_id GROUP BY ALL
