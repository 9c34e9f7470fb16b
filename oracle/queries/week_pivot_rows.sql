WITH ends AS (SELECT financial_week_end_date, CAST(arg_min(financial_period_week, date) AS VARCHAR) AS week FROM fx_dim_date
  WHERE financial_week_end_date BETWEEN DATE '2001-07-29' - 7 * 51 AND DATE '2001-07-29' GROUP BY ALL)
SELECT s.article_id, e.week, round(SUM(s.weekly_sales), 4) AS sales FROM fx_store_article s JOIN ends e ON e.financial_week_end_date = s.financial_week_end_date
WHERE s.category = 'Brand#3' GROUP BY ALL HAVING SUM(s.weekly_sales) IS NOT NULL
