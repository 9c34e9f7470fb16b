SELECT product_ref, product_description AS description FROM (
  SELECT product_ref, product_description, row_number() OVER (PARTITION BY product_ref ORDER BY round(SUM(value_excl_tax), 2) DESC, product_description) AS rn
  FROM fx_market WHERE (department IN ('ECONOMY', 'STANDARD', 'PROMO', 'LARGE') OR segment IN ('Brand#3', 'Brand#11')) AND week_start BETWEEN DATE '2001-08-02' - 735 AND DATE '2001-08-02' - 7 AND product_ref IS NOT NULL GROUP BY product_ref, product_description) q WHERE rn = 1
UNION ALL SELECT DISTINCT NULL, product_description FROM fx_market WHERE (department IN ('ECONOMY', 'STANDARD', 'PROMO', 'LARGE') OR segment IN ('Brand#3', 'Brand#11')) AND week_start BETWEEN DATE '2001-08-02' - 735 AND DATE '2001-08-02' - 7 AND product_ref IS NULL
