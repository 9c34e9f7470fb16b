SELECT scv_id, SUM(sales) AS non_fuel_sales FROM (
  SELECT scv_id, sales, row_number() OVER (PARTITION BY partner_id, txn_date ORDER BY sales DESC, scv_id) AS rn FROM fx_partner_txn WHERE source = 'shop') q WHERE rn = 1 GROUP BY scv_id
