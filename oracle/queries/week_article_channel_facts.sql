WITH head AS (SELECT DISTINCT receipt_id, scv_id, CASE WHEN is_online_order THEN 'Online' ELSE 'In Store' END AS channel, CASE WHEN scv_id <> '' THEN 1 ELSE 0 END AS is_swiped FROM fx_header),
item AS (SELECT l.receipt_id, l.article_id, l.receipt_date, coalesce(l.scv_id, '') AS scv_id, h.channel, h.is_swiped, SUM(gst_included_amount) AS sales, SUM(quantity) AS units, AVG(unit_price_paid) AS price
  FROM fx_line l JOIN head h ON h.receipt_id = l.receipt_id AND h.scv_id = l.scv_id GROUP BY ALL),
red AS (SELECT offer_id, scv_id, receipt_id, article_id, SUM(quantity) AS q, SUM(bonus_points_earn) AS p FROM fx_redeemed GROUP BY ALL)
SELECT k.campaign_name, k.offer_id, k.campaign_period, k.pel_week, k.financial_week_end_date, k.financial_week_start_date, i.channel, i.article_id, b.article_description, b.brand,
  SUM(CASE WHEN r.scv_id IS NOT NULL THEN units ELSE 0 END) AS boosted_units, round(SUM(CASE WHEN r.scv_id IS NOT NULL THEN sales ELSE 0 END), 4) AS boosted_sales,
  round(SUM(sales), 4) AS total_sales, SUM(units) AS total_units, SUM(r.q) AS total_redemptions, round(SUM(r.p) * 0.0091, 4) AS points_cost, CAST(round(CAST(AVG(price) AS DECIMAL(20, 8)), 4) AS DOUBLE) AS avg_unit_price_paid,
  count(DISTINCT i.receipt_id) AS total_transactions, CAST(SUM(is_swiped) AS BIGINT) AS swiped_lines, count(DISTINCT CASE WHEN is_swiped = 1 THEN i.receipt_id END) AS swiped_transactions,
  round(SUM(CASE WHEN is_swiped = 1 THEN sales ELSE 0 END), 4) AS swiped_sales, CAST(count(DISTINCT k.pel_week) AS INT) AS weeks_in_period
FROM item i JOIN fx_brand_article b ON b.article_id = i.article_id JOIN fx_calendar4 k ON k.offer_id = b.offer_id AND k.date = i.receipt_date
LEFT JOIN red r ON r.offer_id = k.offer_id AND r.scv_id = i.scv_id AND r.receipt_id = i.receipt_id AND r.article_id = i.article_id
GROUP BY k.campaign_name, k.offer_id, k.campaign_period, k.pel_week, k.financial_week_end_date, k.financial_week_start_date, i.channel, i.article_id, b.article_description, b.brand
