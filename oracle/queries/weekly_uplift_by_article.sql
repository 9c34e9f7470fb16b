WITH span AS (SELECT offer_id, brand, article_id, article_description, SUM(CASE WHEN campaign_period = 'Pre Campaign' THEN sales END) AS s0, SUM(CASE WHEN campaign_period = 'Campaign Period' THEN sales END) AS s1,
    SUM(CASE WHEN campaign_period = 'Pre Campaign' THEN units END) AS u0, SUM(CASE WHEN campaign_period = 'Campaign Period' THEN units END) AS u1,
    count(DISTINCT CASE WHEN campaign_period = 'Pre Campaign' THEN pel_week END) AS w0, count(DISTINCT CASE WHEN campaign_period = 'Campaign Period' THEN pel_week END) AS w1
  FROM fx_boosted WHERE campaign_period <> 'Post Campaign' GROUP BY ALL)
SELECT offer_id, brand, article_id, article_description, round(s0 / nullif(w0, 0), 4) AS weekly_sales_pre, round(s1 / nullif(w1, 0), 4) AS weekly_sales_campaign, round(u0 / nullif(w0, 0), 4) AS weekly_units_pre,
  round(u1 / nullif(w1, 0), 4) AS weekly_units_campaign, round((s1 / nullif(w1, 0) - s0 / nullif(w0, 0)) / nullif(s0 / nullif(w0, 0), 0), 4) AS sales_uplift,
  round((u1 / nullif(w1, 0) - u0 / nullif(w0, 0)) / nullif(u0 / nullif(w0, 0), 0), 4) AS units_uplift FROM span
