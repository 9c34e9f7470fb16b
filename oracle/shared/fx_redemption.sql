SELECT r.offer_id, r.scv_id, r.redemption_date, k.pel_week, r.receipt_id,
  CASE WHEN EXISTS (SELECT 1 FROM fx_header h WHERE h.scv_id = r.scv_id AND h.receipt_id = r.receipt_id AND h.is_online_order) THEN 'Online' ELSE 'In Store' END AS channel,
  r.article_id, b.brand, b.article_description, r.quantity AS redemptions, r.store_id, r.total_item_sales_amount AS basket_redemption_total,
  SUM(r.base_points_earn) AS base_points_earn, SUM(r.bonus_points_earn) AS bonus_points_earn, SUM(r.reward_value) AS reward_value
FROM fx_redeemed r LEFT JOIN fx_brand_article b ON b.offer_id = r.offer_id AND b.article_id = r.article_id
LEFT JOIN fx_calendar k ON k.offer_id = r.offer_id AND k.date = r.redemption_date
GROUP BY ALL
