WITH item AS (SELECT receipt_id, commercial_id, article_id, SUM(gst_included_amount) AS amount, max(receipt_date) AS receipt_date, max(coalesce(scv_id, '')) AS scv_id
  FROM fx_line GROUP BY receipt_id, commercial_id, article_id),
sold AS (SELECT k.offer_id, k.financial_week_start_date, k.pel_week, k.campaign_period, b.brand, CASE WHEN i.commercial_id = '' THEN i.receipt_id ELSE i.commercial_id END AS txn, i.scv_id <> '' AS swiped, i.amount
  FROM item i JOIN fx_brand_article b ON b.article_id = i.article_id JOIN fx_calendar k ON k.offer_id = b.offer_id AND k.date = i.receipt_date WHERE k.campaign_period IS NOT NULL),
rate AS (SELECT offer_id, financial_week_start_date, pel_week, campaign_period, brand,
    count(DISTINCT CASE WHEN swiped THEN txn END) / nullif(count(DISTINCT txn), 0) AS scan_rate, SUM(CASE WHEN swiped THEN amount ELSE 0 END) / nullif(SUM(amount), 0) AS tag_rate
  FROM sold GROUP BY ALL)
SELECT offer_id, financial_week_start_date, pel_week, campaign_period, brand, round(scan_rate, 4) AS scan_rate, round(tag_rate, 4) AS tag_rate,
  round(avg(scan_rate) OVER (PARTITION BY brand, campaign_period), 4) AS avg_scan_rate, round(avg(tag_rate) OVER (PARTITION BY brand, campaign_period), 4) AS avg_tag_rate FROM rate
