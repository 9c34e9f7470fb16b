SELECT CAST(year(d.financial_week_start_date) AS INT) AS year, d.financial_week_start_date, l.store_id, round(SUM(l.gst_included_amount), 4) AS sales, SUM(l.quantity) AS quantity
FROM fx_line l JOIN fx_dim_date d ON d.date = l.receipt_date
WHERE year(d.financial_week_start_date) < 2001 OR l.l_returnflag <> 'R'
GROUP BY d.financial_week_start_date, l.store_id
