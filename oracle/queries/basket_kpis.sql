WITH basket AS (SELECT scv_id, CASE WHEN is_online_order THEN commercial_id ELSE receipt_id END AS txn, receipt_date, SUM(gst_included_amount) AS amount, SUM(quantity) AS quantity
  FROM fx_header WHERE scv_id <> '' GROUP BY ALL),
redeemer AS (SELECT DISTINCT offer_id, scv_id FROM fx_reward WHERE offer_id IN (SELECT offer_id FROM fx_brand_article))
SELECT k.offer_id, k.campaign_period, CASE WHEN r.scv_id IS NULL THEN 'Non Redeemer' ELSE 'Redeemer' END AS redeemer_group, count(DISTINCT b.scv_id) AS unique_customers,
  round(count(DISTINCT txn) / nullif(count(DISTINCT pel_week), 0), 4) AS baskets_per_week, round(SUM(amount) / nullif(count(DISTINCT txn), 0), 4) AS avg_basket_size,
  round(SUM(quantity) / nullif(count(DISTINCT txn), 0), 4) AS avg_basket_qty
FROM basket b JOIN fx_calendar k ON k.date = b.receipt_date LEFT JOIN redeemer r ON r.scv_id = b.scv_id AND r.offer_id = k.offer_id
WHERE k.campaign_period IS NOT NULL GROUP BY ALL
