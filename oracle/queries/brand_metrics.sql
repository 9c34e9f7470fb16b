WITH item AS (SELECT scv_id, receipt_id, article_id, SUM(gst_included_amount) AS amount FROM fx_line WHERE scv_id <> '' GROUP BY ALL),
total AS (SELECT r.offer_id, r.brand, SUM(r.redemptions) AS redemptions, count(DISTINCT r.scv_id) AS unique_redeemers, round(SUM(i.amount), 4) AS boosted_sales,
    round(SUM(r.bonus_points_earn) * 0.0091, 4) AS points_cost, round(SUM(i.amount) / nullif(SUM(r.bonus_points_earn) * 0.0091, 0), 4) AS sales_to_cost_ratio
  FROM fx_redemption r LEFT JOIN item i ON i.scv_id = r.scv_id AND i.receipt_id = r.receipt_id AND i.article_id = r.article_id GROUP BY r.offer_id, r.brand),
kind AS (SELECT offer_id, brand, count(*) FILTER (redeemer_type = 'New') AS new_to_brand_redeemers, count(*) FILTER (redeemer_type = 'Reactivated') AS reactivated_redeemers,
    count(*) FILTER (redeemer_type = 'Repeat') AS repeat_redeemers FROM fx_weekly_segment GROUP BY ALL),
shop AS (SELECT offer_id, brand, count(DISTINCT CASE WHEN in_campaign THEN scv_id END) AS brand_shoppers FROM fx_weekly_purchase GROUP BY ALL),
idle AS (SELECT w.offer_id, w.brand, count(DISTINCT w.scv_id) AS non_boosters FROM fx_weekly_purchase w
  LEFT JOIN fx_activation a ON a.offer_id = w.offer_id AND a.scv_id = w.scv_id WHERE w.in_campaign AND a.scv_id IS NULL GROUP BY ALL),
kept AS (SELECT g.offer_id, g.brand, count(DISTINCT CASE WHEN redeemer_type = 'New' THEN g.scv_id END) AS n, count(DISTINCT CASE WHEN redeemer_type = 'Reactivated' THEN g.scv_id END) AS b,
    count(DISTINCT CASE WHEN redeemer_type = 'Repeat' THEN g.scv_id END) AS a
  FROM fx_weekly_segment g JOIN fx_weekly_purchase w ON w.offer_id = g.offer_id AND w.brand = g.brand AND w.scv_id = g.scv_id WHERE w.in_post GROUP BY ALL)
SELECT total.*, kind.new_to_brand_redeemers, kind.reactivated_redeemers, kind.repeat_redeemers, shop.brand_shoppers, coalesce(n, 0) AS retained_new_to_brand_shoppers,
  coalesce(b, 0) AS retained_reactivated_shoppers, coalesce(a, 0) AS retained_repeat_shoppers, idle.non_boosters
FROM total LEFT JOIN kind USING (offer_id, brand) LEFT JOIN shop USING (offer_id, brand) LEFT JOIN kept USING (offer_id, brand) LEFT JOIN idle USING (offer_id, brand)
