SELECT scv_id, SUM(sales_total) AS total_sales, SUM(sales_fuel) AS total_sales_fuel, SUM(sales_total) - SUM(sales_fuel) AS total_sales_shop, count(DISTINCT receipt_id) AS transactions,
  count(DISTINCT fuel_receipt) AS fuel_transactions, count(DISTINCT receipt_id) - count(DISTINCT fuel_receipt) AS shop_transactions, SUM(litres) AS total_litres,
  SUM(litres) / nullif(count(DISTINCT fuel_receipt), 0) AS average_litres, date_diff('day', min(fuel_date), DATE '2001-08-02') / nullif(count(DISTINCT fuel_receipt), 0) AS days_to_fuel,
  date_diff('day', min(txn_date), DATE '2001-08-02') / nullif(count(DISTINCT receipt_id) - count(DISTINCT fuel_receipt), 0) AS days_to_shop, SUM(discount) AS discount_total,
  count(*) FILTER (txn_date >= DATE '2001-08-02' - 56) AS last_2m, count(*) FILTER (txn_date >= DATE '2001-08-02' - 112 AND txn_date < DATE '2001-08-02' - 56) AS previous_2m_to_last_2m,
  count(*) FILTER (txn_date < DATE '2001-08-02' - 112) AS before_4m, min(txn_date) AS first_date, max(txn_date) AS last_date
FROM (SELECT DISTINCT scv_id, receipt_id, txn_date, CASE WHEN redemption_type = 'cpl discount' THEN txn_date END AS fuel_date, CASE WHEN lower(redemption_type) IN ('base', 'bonus') THEN sales END AS sales_total,
        CASE WHEN redemption_type = 'cpl discount' THEN sales END AS sales_fuel, CASE WHEN redemption_type = 'cpl discount' THEN quantity END AS litres,
        CASE WHEN redemption_type = 'cpl discount' THEN receipt_id END AS fuel_receipt, CASE WHEN redemption_type = 'cpl discount' THEN discount / nullif(quantity, 0) END AS discount
      FROM fx_partner_txn WHERE source = 'fuel' AND partner_id = '2') q GROUP BY scv_id
