SELECT c.offer_id, c.offer_name, c.campaign_name, d.*,
  CASE WHEN d.date BETWEEN c.pre_start_date AND c.pre_end_date THEN 'Pre Campaign' WHEN d.date BETWEEN c.campaign_start_date AND c.campaign_end_date THEN 'Campaign Period'
       WHEN d.date BETWEEN c.post_start_date AND c.post_end_date THEN 'Post Campaign' END AS campaign_period
FROM fx_config c JOIN fx_dim_date d ON d.date BETWEEN c.long_start_date AND c.post_end_date
