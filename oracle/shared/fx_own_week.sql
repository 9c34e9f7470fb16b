SELECT article_id, department, segment, CAST(date_trunc('week', calendar_day) AS DATE) AS week_start, SUM(sales) AS sales, SUM(interim_gp) AS interim_gp, SUM(manual_claims) AS manual_claims,
  SUM(interim_gp - manual_claims) AS interim_gp_net, SUM(quantity) AS quantity
FROM fx_profit WHERE sales_org = 'ORG2' AND (department IN ('ECONOMY', 'STANDARD', 'PROMO', 'LARGE') OR segment IN ('Brand#3', 'Brand#11'))
  AND CAST(date_trunc('week', calendar_day) AS DATE) BETWEEN DATE '2001-08-02' - 728 AND DATE '2001-08-02' - 7 GROUP BY ALL
