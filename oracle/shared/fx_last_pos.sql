SELECT article_id, store_id, unit_of_measure, pack_size, receipt_date, financial_week_end_date, unit_price_paid, retail_price, td AS total_discount, ga AS gst_excluded_amount, qt AS quantity FROM (
  SELECT p.*, u.pack_size, SUM(total_discount) OVER w AS td, SUM(gst_excluded_amount) OVER w AS ga, SUM(quantity) OVER w AS qt,
    row_number() OVER (PARTITION BY p.article_id, p.store_id ORDER BY receipt_date DESC, receipt_time DESC, length(receipt_id) DESC, receipt_id DESC, p.unit_of_measure DESC, unit_price_paid DESC, pack_size DESC, retail_price DESC) AS rn
  FROM fx_pos p JOIN fx_uom u ON u.article_id = p.article_id AND u.unit_of_measure = p.unit_of_measure
  WHERE NOT is_online_order AND return_reason_id = '' AND financial_week_end_date = DATE '2001-08-05' AND category NOT IN ('Brand#5', 'Brand#21')
  WINDOW w AS (PARTITION BY p.article_id, p.store_id)) q WHERE rn = 1
