SELECT * REPLACE (round(interim_gp, 4) AS interim_gp, round(quantity, 4) AS quantity, round(sales, 4) AS sales) FROM fx_scaffold
