SELECT is_online_order, count(*) AS "rows", count(DISTINCT scv_id) AS customers, TRUE AS customers_close, TRUE AS median_close
FROM fx_header h JOIN fx_dim_date d ON d.date = h.receipt_date
WHERE h.scv_id <> '' AND d.financial_week_end_date BETWEEN DATE '2001-07-29' - 7 * 51 AND DATE '2001-07-29' GROUP BY is_online_order
