SELECT * REPLACE (round(trailing_sales, 4) AS trailing_sales) FROM fx_trailing
