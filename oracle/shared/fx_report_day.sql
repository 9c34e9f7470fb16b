SELECT CAST(dense_rank() OVER (ORDER BY financial_week_start_date DESC) AS INT) AS latest_week_order, pel_week, date, financial_week_end_date AS week_end_date, financial_year, calendar_year, financial_week_start_date
FROM fx_dim_date WHERE financial_week_start_date BETWEEN DATE '2001-08-02' - 728 AND DATE '2001-08-02' - 7
