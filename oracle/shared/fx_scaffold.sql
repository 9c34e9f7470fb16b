SELECT w.article_id, d.date, d.financial_year, d.pel_week, w.week,
  CAST(date_diff('day', (SELECT max(date) FROM fx_dim_date WHERE holiday_name = 'Christmas Day' AND financial_year = 2001), d.date) AS INT) AS days_out_ty,
  CAST(date_diff('day', (SELECT max(date) FROM fx_dim_date WHERE holiday_name = 'Christmas Day' AND financial_year = 2000), d.date) AS INT) AS days_out_ly,
  f.interim_gp, f.quantity, f.sales
FROM fx_plan_week w JOIN fx_dim_date d ON CAST(w.week AS INT) = d.week_of_financial_year AND d.financial_year IN (2000, 2001)
LEFT JOIN (SELECT article_id, calendar_day, SUM(interim_gp) AS interim_gp, SUM(quantity) AS quantity, SUM(sales) AS sales FROM fx_profit
  WHERE sales_org = 'ORG2' AND calendar_day > DATE '2001-06-15' - 742 GROUP BY ALL) f ON f.article_id = w.article_id AND f.calendar_day = d.date
