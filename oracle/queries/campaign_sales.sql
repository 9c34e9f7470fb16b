SELECT * REPLACE (round(gst_included_amount, 4) AS gst_included_amount, round(quantity, 4) AS quantity) FROM fx_sales
