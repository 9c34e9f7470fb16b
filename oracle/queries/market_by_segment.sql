SELECT * REPLACE (round(total_sales, 4) AS total_sales, round(competitor_sales, 4) AS competitor_sales, round(own_sales, 4) AS own_sales, round(franchise_sales, 4) AS franchise_sales) FROM fx_spread
