SELECT k.offer_id, k.financial_week_start_date, k.campaign_period, k.pel_week, b.brand, s.receipt_id, s.article_id, b.article_description, s.receipt_date, s.scv_id, s.sales, s.units, s.unit_price_paid,
  CASE WHEN r.scv_id IS NOT NULL THEN s.units END AS boosted_units, CASE WHEN r.scv_id IS NOT NULL THEN s.sales END AS boosted_sales
FROM (SELECT receipt_id, article_id, max(receipt_date) AS receipt_date, max(coalesce(scv_id, '')) AS scv_id, SUM(gst_included_amount) AS sales, SUM(quantity) AS units, AVG(unit_price_paid) AS unit_price_paid
      FROM fx_line GROUP BY receipt_id, article_id) s
JOIN fx_brand_article b ON b.article_id = s.article_id JOIN fx_calendar4 k ON k.offer_id = b.offer_id AND k.date = s.receipt_date
LEFT JOIN (SELECT DISTINCT offer_id, scv_id, receipt_id, article_id FROM fx_redeemed) r ON r.offer_id = k.offer_id AND r.scv_id = s.scv_id AND r.receipt_id = s.receipt_id AND r.article_id = s.article_id
