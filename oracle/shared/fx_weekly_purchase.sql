SELECT DISTINCT c.offer_id, b.brand, l.scv_id, d.financial_week_start_date AS week,
  d.financial_week_start_date BETWEEN c.recent_start_date AND c.pre_end_date AS in_recent, d.financial_week_start_date BETWEEN c.long_start_date AND c.pre_end_date AS in_long,
  d.financial_week_start_date BETWEEN c.campaign_start_date AND c.campaign_end_date AS in_campaign, d.financial_week_start_date BETWEEN c.post_start_date AND c.post_end_date AS in_post
FROM fx_line l JOIN fx_dim_date d ON d.date = l.receipt_date JOIN fx_brand_article b ON b.article_id = l.article_id JOIN fx_config c ON c.offer_id = b.offer_id
WHERE l.scv_id <> '' AND l.gst_included_amount > 0
