SELECT * REPLACE (round(sales, 4) AS sales, CAST(round(CAST(unit_price_paid AS DECIMAL(20, 8)), 4) AS DOUBLE) AS unit_price_paid, round(boosted_sales, 4) AS boosted_sales) FROM fx_boosted
