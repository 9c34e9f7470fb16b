SELECT week_start, product_ref, segment, department, description,
  SUM(total_sales) AS total_sales, SUM(total_units) AS total_units, SUM(competitor_sales) AS competitor_sales, SUM(competitor_units) AS competitor_units, SUM(own_sales) AS own_sales, SUM(own_units) AS own_units, SUM(franchise_sales) AS franchise_sales, SUM(franchise_units) AS franchise_units
FROM (SELECT s.week_start, s.product_ref, s.segment, s.department, c.description, total_sales, total_units, competitor_sales, competitor_units, own_sales, own_units, franchise_sales, franchise_units FROM fx_spread s JOIN fx_canonical c ON c.product_ref = s.product_ref
  UNION ALL SELECT s.week_start, s.product_ref, s.segment, s.department, c.description, total_sales, total_units, competitor_sales, competitor_units, own_sales, own_units, franchise_sales, franchise_units FROM fx_spread s JOIN fx_canonical c ON c.description = s.product_description AND c.product_ref IS NULL) q
GROUP BY week_start, product_ref, segment, department, description
