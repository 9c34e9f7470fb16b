SELECT DISTINCT receipt_id, receipt_date, CAST(floor((DATE '2001-08-02' - DATE '1970-01-04') / 7.0) - floor((receipt_date - DATE '1970-01-04') / 7.0) AS INT) AS sunday_weeks,
  receipt_date - CAST(dayofweek(receipt_date) AS INT) AS sunday_start, CAST(date_trunc('week', receipt_date) AS DATE) AS monday_start,
  receipt_date - CAST(dayofweek(receipt_date) AS INT) + CASE WHEN dayofweek(receipt_date) = 1 THEN 0 ELSE 7 END AS report_week_end, dayofweek(receipt_date) = 1 AS monday,
  receipt_date - 84 AS twelve_weeks_before, CAST(receipt_date - INTERVAL 2 MONTHS AS DATE) AS two_months_before, CAST(date_diff('day', receipt_date, DATE '2001-08-02') AS INT) AS days_ago,
  round(100 / nullif(date_diff('day', receipt_date, DATE '2001-08-02') / 30, 0), 4) AS hundred_per_month FROM fx_line
