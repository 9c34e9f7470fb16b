WITH spans AS (SELECT offer_id, pre_start_date, post_end_date FROM fx_config
  UNION ALL SELECT offer_id || '-later', CAST(pre_start_date + INTERVAL 1200 MONTH AS DATE), CAST(post_end_date + INTERVAL 1200 MONTH AS DATE) FROM fx_config)
SELECT s.offer_id, s.pre_start_date, s.post_end_date, d.date, d.pel_week FROM spans s LEFT JOIN fx_dim_date d ON d.date BETWEEN s.pre_start_date AND s.post_end_date
