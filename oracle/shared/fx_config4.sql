SELECT *, campaign_start_date - 28 AS pre_start_date, campaign_start_date - 1 AS pre_end_date, campaign_end_date + 1 AS post_start_date,
  campaign_end_date + 28 AS post_end_date, campaign_start_date - 182 AS recent_start_date, campaign_start_date - 364 AS long_start_date
FROM fx_config_all
