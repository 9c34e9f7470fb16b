SELECT * REPLACE (round(pre_sales, 4) AS pre_sales, round(pre_swiped_sales, 4) AS pre_swiped_sales, round(campaign_sales, 4) AS campaign_sales, round(campaign_swiped_sales, 4) AS campaign_swiped_sales) FROM fx_uplift
