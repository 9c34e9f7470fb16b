SELECT offer_id, brand, article_id, receipt_id, customer AS scv_id, txn_date,
  txn_date BETWEEN recent_start_date AND pre_end_date AS in_recent, txn_date BETWEEN long_start_date AND pre_end_date AS in_long,
  txn_date BETWEEN pre_start_date AND pre_end_date AS in_pre, txn_date BETWEEN campaign_start_date AND campaign_end_date AS in_campaign,
  txn_date BETWEEN post_start_date AND post_end_date AS in_post,
  SUM(gst_included_amount) AS gst_included_amount, SUM(quantity) AS quantity, bool_or(gst_included_amount > 0) AS has_positive_line
FROM (SELECT c.*, b.brand, l.article_id, l.receipt_id, NULLIF(l.scv_id, '') AS customer, l.gst_included_amount, l.quantity,
        CASE WHEN l.is_online_order THEN l.online_order_date ELSE l.receipt_date END AS txn_date
      FROM fx_line l JOIN fx_brand_article b ON b.article_id = l.article_id JOIN fx_config c ON c.offer_id = b.offer_id
      WHERE l.receipt_date BETWEEN c.long_start_date AND c.post_end_date + 14
        AND ((NOT l.is_online_order AND l.receipt_date <= c.post_end_date) OR (l.is_online_order_completed AND l.online_order_date BETWEEN c.long_start_date AND c.post_end_date))) q
GROUP BY ALL
