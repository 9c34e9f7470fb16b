WITH r AS (SELECT receipt_id, receipt_date, round(gst_included_amount, 2) AS amount FROM fx_header)
SELECT receipt_id, receipt_date, amount, row_number() OVER w AS number, round(SUM(amount) OVER w, 4) AS amount_so_far, lag(amount) OVER w AS amount_before, lead(amount) OVER w AS amount_after,
  CAST(receipt_date - lag(receipt_date, 10) OVER w AS INT) AS days_since_tenth, round(round(avg(amount) OVER (ORDER BY receipt_date, receipt_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 8), 4) AS mean_of_50
FROM r WINDOW w AS (ORDER BY receipt_date, receipt_id)
