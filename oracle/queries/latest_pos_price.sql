SELECT * REPLACE (CAST(round(CAST(unit_price_paid AS DECIMAL(20, 8)), 4) AS DOUBLE) AS unit_price_paid, round(total_discount, 4) AS total_discount, round(gst_excluded_amount, 4) AS gst_excluded_amount) FROM fx_last_pos
