SELECT *, round(((campaign_sales / nullif(campaign_duration_weeks, 0)) - pre_sales / 4) / nullif(pre_sales / 4, 0), 4) AS sales_uplift,
  round(((campaign_units / nullif(campaign_duration_weeks, 0)) - pre_units / 4) / nullif(pre_units / 4, 0), 4) AS units_uplift,
  round((campaign_swiped_baskets / nullif(campaign_baskets, 0) - pre_swiped_baskets / nullif(pre_baskets, 0)) / nullif(pre_swiped_baskets / nullif(pre_baskets, 0), 0), 4) AS scan_rate_uplift,
  round((campaign_swiped_sales / nullif(campaign_sales, 0) - pre_swiped_sales / nullif(pre_sales, 0)) / nullif(pre_swiped_sales / nullif(pre_sales, 0), 0), 4) AS tag_rate_uplift
FROM (SELECT s.offer_id, s.brand, c.campaign_duration_weeks,
    count(DISTINCT CASE WHEN in_pre THEN receipt_id END) AS pre_baskets, count(DISTINCT CASE WHEN in_pre AND scv_id IS NOT NULL THEN receipt_id END) AS pre_swiped_baskets,
    count(DISTINCT CASE WHEN in_campaign THEN receipt_id END) AS campaign_baskets, count(DISTINCT CASE WHEN in_campaign AND scv_id IS NOT NULL THEN receipt_id END) AS campaign_swiped_baskets,
    SUM(CASE WHEN in_pre THEN gst_included_amount END) AS pre_sales, SUM(CASE WHEN in_pre AND scv_id IS NOT NULL THEN gst_included_amount END) AS pre_swiped_sales,
    SUM(CASE WHEN in_campaign THEN gst_included_amount END) AS campaign_sales, SUM(CASE WHEN in_campaign AND scv_id IS NOT NULL THEN gst_included_amount END) AS campaign_swiped_sales,
    SUM(CASE WHEN in_pre THEN quantity END) AS pre_units, SUM(CASE WHEN in_campaign THEN quantity END) AS campaign_units
  FROM fx_sales s JOIN fx_config c ON c.offer_id = s.offer_id WHERE in_pre OR in_campaign GROUP BY ALL) q
