SELECT article_id, department, category, sub_category, segment, CAST(date_trunc('week', calendar_day) AS DATE) AS week_start, SUM(sales) AS sales, SUM(interim_gp) AS interim_gp, SUM(trading_gp) AS trading_gp,
  SUM(dumps) AS dumps, SUM(stock_loss) AS stock_loss, SUM(markdowns) AS markdowns, SUM(manual_claims) AS manual_claims, SUM(cogs) AS cogs, SUM(interim_gp - manual_claims) AS interim_gp_net, SUM(quantity) AS quantity
FROM fx_profit WHERE sales_org = 'ORG2' AND category <> 'Range 4' AND (department IN ('ECONOMY', 'STANDARD') OR upper(sub_category) IN ('RING', 'ANVIL'))
  AND CAST(date_trunc('week', calendar_day) AS DATE) BETWEEN DATE '2001-08-02' - 728 AND DATE '2001-08-02' - 7 GROUP BY ALL
