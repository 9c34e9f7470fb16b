SELECT scv_id, CAST(max(CASE WHEN name = 'NATION_2' THEN 1 ELSE 0 END) AS INT) AS partner_customer, count(DISTINCT name) AS different_partners
FROM (SELECT p.scv_id, replace(n.partner_name, '_NZ', '') AS name FROM fx_points p JOIN fx_partner n ON n.partner_id = p.partner_id) q GROUP BY scv_id
