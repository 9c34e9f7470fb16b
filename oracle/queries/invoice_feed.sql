WITH total AS (SELECT offer_id, offer_name, offer_type, offer_target_type, product_offer_type, pel_week, SUM(offer_redeemed_count) AS total_redeemed, SUM(bonus_points_earn) AS total_bonus_points
  FROM fx_kpi WHERE offer_start_date < DATE '2001-08-02' AND allocated_scv_id <> 'Invalid' AND week_number IS NOT NULL AND lower(offer_name) NOT LIKE '%pinned%' AND offer_type = 'product offer' GROUP BY ALL),
own AS (SELECT DISTINCT r.offer_id, v.own_brand FROM fx_reward r LEFT JOIN fx_article_vendor v ON v.article_id = r.article_id)
SELECT t.offer_id, t.pel_week, split_part(t.offer_name, '|', 2) AS offer_name, t.offer_type, t.offer_target_type, t.product_offer_type, own.own_brand, l.vendor_count, l.articles AS articles_json,
  l.vendor_ids AS vendor_ids_json, l.vendor_descriptions AS vendor_descriptions_json, t.total_redeemed, t.total_bonus_points
FROM total t LEFT JOIN fx_vendor_lists l ON l.offer_id = t.offer_id LEFT JOIN own ON own.offer_id = t.offer_id
