SELECT l.sales_org, l.site AS store_id, l.article_id, l.unit_of_measure, l.rrp, l.valid_from, l.valid_to, l.price_list, l.life_cycle_status, l.life_cycle_date, a.price_family_name, a.category_manager, a.vendor_description, a.own_brand, b.store_brand, w.sourcing_dc_name, a.article_name, a.price_family_id, a.department, a.category, a.sub_category, a.segment,
  r.pack_size, r.retail_price, r.receipt_date, r.financial_week_end_date AS pos_week_end_date, round(t.trailing_sales, 4) AS trailing_sales, s.price AS shelf_price, s.financial_week_end_date AS shelf_week_end_date,
  s.is_clearance, s.is_multibuy, s.is_great_price, k.price AS recommended_price, w.wholesale_cost_price, w.wholesale_unit_price, w.sourcing_dc, coalesce(f.primary_line, 'N') AS primary_line,
  CASE WHEN l.article_id IN (SELECT article_id FROM fx_promise) THEN 'Y' ELSE 'N' END AS price_promise, b.store_name
FROM fx_price_list l JOIN fx_article a ON a.article_id = l.article_id
LEFT JOIN fx_last_pos r ON r.store_id = l.site AND r.article_id = l.article_id AND r.unit_of_measure = l.unit_of_measure
LEFT JOIN fx_trailing t ON t.store_id = l.site AND t.article_id = l.article_id AND t.unit_of_measure = l.unit_of_measure
LEFT JOIN fx_shelf s ON s.article_id = l.article_id AND s.unit_of_measure = l.unit_of_measure
LEFT JOIN fx_recommended k ON k.article_id = l.article_id AND k.unit_of_measure = l.unit_of_measure
LEFT JOIN fx_wholesale w ON w.article_id = l.article_id AND w.unit_of_measure = l.unit_of_measure
LEFT JOIN fx_family f ON f.price_family_id = a.price_family_id LEFT JOIN fx_store b ON b.store_id = l.site
WHERE a.category NOT IN ('Brand#5', 'Brand#21') AND a.sub_category NOT IN ('old rod', 'cold rod')
