SELECT r.offer_id, b.brand, SUM(r.quantity) AS redemptions, count(DISTINCT r.scv_id) AS unique_redeemers, round(SUM(s.amount), 4) AS boosted_sales, SUM(r.bonus_points_earn) AS bonus_points,
  count(DISTINCT CASE WHEN g.redeemer_type = 'New' THEN r.scv_id END) AS new_to_brand_redeemers,
  count(DISTINCT CASE WHEN g.redeemer_type = 'Reactivated' THEN r.scv_id END) AS reactivated_redeemers,
  count(DISTINCT CASE WHEN g.redeemer_type = 'Repeat' THEN r.scv_id END) AS repeat_redeemers,
  round(SUM(r.bonus_points_earn) * 0.0091, 4) AS points_cost, round(SUM(s.amount) / nullif(SUM(r.bonus_points_earn) * 0.0091, 0), 4) AS sales_to_cost_ratio
FROM fx_redeemed r JOIN fx_brand_article b ON b.offer_id = r.offer_id AND b.article_id = r.article_id
LEFT JOIN (SELECT offer_id, brand, receipt_id, article_id, SUM(gst_included_amount) AS amount FROM fx_sales GROUP BY ALL) s
  ON s.offer_id = r.offer_id AND s.brand = b.brand AND s.receipt_id = r.receipt_id AND s.article_id = r.article_id
LEFT JOIN fx_segment g ON g.offer_id = r.offer_id AND g.brand = b.brand AND g.scv_id = r.scv_id
GROUP BY r.offer_id, b.brand
