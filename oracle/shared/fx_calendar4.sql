SELECT c.offer_id, c.offer_name, c.campaign_name, d.*,
  CASE WHEN d.date < c.campaign_start_date THEN 'Pre Campaign' WHEN d.date <= c.campaign_end_date THEN 'Campaign Period' ELSE 'Post Campaign' END AS campaign_period
FROM fx_config4 c JOIN fx_dim_date d ON d.date BETWEEN c.pre_start_date AND c.post_end_date WHERE c.offer_id <> '1'
