SELECT * REPLACE (round(sales, 4) AS sales, round(interim_gp, 4) AS interim_gp, round(manual_claims, 4) AS manual_claims, round(interim_gp_net, 4) AS interim_gp_net, round(total_sales, 4) AS total_sales, round(competitor_sales, 4) AS competitor_sales, round(own_sales, 4) AS own_sales, round(franchise_sales, 4) AS franchise_sales) FROM fx_combined
