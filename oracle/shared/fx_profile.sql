SELECT offer_id, brand,
  count(DISTINCT CASE WHEN redeemer_type = 'Repeat' AND category = 'automobile' THEN scv_id END) AS repeat_automobile_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'Reactivated' AND category = 'automobile' THEN scv_id END) AS reactivated_automobile_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'New' AND category = 'automobile' THEN scv_id END) AS new_to_brand_automobile_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'Repeat' AND category = 'building' THEN scv_id END) AS repeat_building_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'Reactivated' AND category = 'building' THEN scv_id END) AS reactivated_building_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'New' AND category = 'building' THEN scv_id END) AS new_to_brand_building_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'Repeat' AND category = 'furniture' THEN scv_id END) AS repeat_furniture_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'Reactivated' AND category = 'furniture' THEN scv_id END) AS reactivated_furniture_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'New' AND category = 'furniture' THEN scv_id END) AS new_to_brand_furniture_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'Repeat' AND category = 'household' THEN scv_id END) AS repeat_household_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'Reactivated' AND category = 'household' THEN scv_id END) AS reactivated_household_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'New' AND category = 'household' THEN scv_id END) AS new_to_brand_household_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'Repeat' AND category = 'no_segment' THEN scv_id END) AS repeat_no_segment_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'Reactivated' AND category = 'no_segment' THEN scv_id END) AS reactivated_no_segment_customers,
  count(DISTINCT CASE WHEN redeemer_type = 'New' AND category = 'no_segment' THEN scv_id END) AS new_to_brand_no_segment_customers
FROM (SELECT g.*, lower(coalesce(h.segment_group, 'no_segment')) AS category FROM fx_segment g JOIN fx_config c ON c.offer_id = g.offer_id
  LEFT JOIN fx_feature_history h ON h.scv_id = g.scv_id AND h.at_date = c.campaign_start_date) q
GROUP BY offer_id, brand
