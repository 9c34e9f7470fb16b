SELECT * REPLACE (round(total_sales, 4) AS total_sales, round(total_sales_fuel, 4) AS total_sales_fuel, round(total_sales_shop, 4) AS total_sales_shop, round(average_litres, 4) AS average_litres,
  round(days_to_fuel, 4) AS days_to_fuel, round(days_to_shop, 4) AS days_to_shop, round(discount_total, 4) AS discount_total) FROM fx_recency
