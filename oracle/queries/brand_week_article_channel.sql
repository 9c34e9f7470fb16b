SELECT r.offer_id, r.brand, r.article_description, r.pel_week, r.channel, SUM(r.redemptions) AS redemptions, round(SUM(l.amount), 4) AS gst_included_amount, round(SUM(r.bonus_points_earn) * 0.0091, 4) AS points_cost
FROM fx_redemption r LEFT JOIN (SELECT scv_id, receipt_id, article_id, SUM(gst_included_amount) AS amount FROM fx_line WHERE scv_id <> '' GROUP BY ALL) l
  ON l.scv_id = r.scv_id AND l.receipt_id = r.receipt_id AND l.article_id = r.article_id GROUP BY ALL
