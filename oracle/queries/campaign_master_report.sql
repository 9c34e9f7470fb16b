SELECT c.*, p.* EXCLUDE (offer_id), a.total_activations, t.* EXCLUDE (offer_id, brand), u.sales_uplift, u.units_uplift, u.scan_rate_uplift, u.tag_rate_uplift, f.* EXCLUDE (offer_id, brand)
FROM fx_config c LEFT JOIN fx_performance p ON p.offer_id = c.offer_id
LEFT JOIN (SELECT offer_id, count(DISTINCT scv_id) AS total_activations FROM fx_activation GROUP BY offer_id) a ON a.offer_id = c.offer_id
LEFT JOIN fx_retention t ON t.offer_id = p.offer_id AND t.brand = p.brand
LEFT JOIN fx_uplift u ON u.offer_id = p.offer_id AND u.brand = p.brand
LEFT JOIN fx_profile f ON f.offer_id = p.offer_id AND f.brand = p.brand
