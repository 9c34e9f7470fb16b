SELECT week_start, product_ref, department, category, sub_category, segment, description, SUM(total_sales) AS total_sales, SUM(total_units) AS total_units, SUM(competitor_sales) AS competitor_sales, SUM(competitor_units) AS competitor_units, SUM(own_sales) AS own_sales, SUM(own_units) AS own_units, SUM(franchise_sales) AS franchise_sales, SUM(franchise_units) AS franchise_units FROM (
  SELECT s.*, c.description FROM (
    SELECT week_start, product_ref, department, category, sub_category, segment, product_description, SUM(CASE WHEN market = 'Total' THEN value_excl_tax ELSE 0 END) AS total_sales, SUM(CASE WHEN market = 'Total' THEN units ELSE 0 END) AS total_units,
  SUM(CASE WHEN market = 'Competitor' THEN value_excl_tax ELSE 0 END) AS competitor_sales, SUM(CASE WHEN market = 'Competitor' THEN units ELSE 0 END) AS competitor_units,
  SUM(CASE WHEN market = 'Own' THEN value_excl_tax ELSE 0 END) AS own_sales, SUM(CASE WHEN market = 'Own' THEN units ELSE 0 END) AS own_units,
  SUM(CASE WHEN market = 'Franchise' THEN value_excl_tax ELSE 0 END) AS franchise_sales, SUM(CASE WHEN market = 'Franchise' THEN units ELSE 0 END) AS franchise_units
    FROM fx_market WHERE (department IN ('ECONOMY', 'STANDARD') OR upper(sub_category) IN ('RING', 'ANVIL')) AND week_start BETWEEN DATE '2001-08-02' - 728 AND DATE '2001-08-02' - 7 GROUP BY ALL) s
  JOIN (
    SELECT product_ref AS ref, product_description AS description, product_ref AS by_ref, NULL AS by_text FROM (
      SELECT product_ref, product_description, row_number() OVER (PARTITION BY product_ref ORDER BY round(SUM(value_excl_tax), 2) DESC, product_description) AS rn
      FROM fx_market WHERE (department IN ('ECONOMY', 'STANDARD') OR upper(sub_category) IN ('RING', 'ANVIL')) AND week_start BETWEEN DATE '2001-08-02' - 735 AND DATE '2001-08-02' - 7 AND product_ref IS NOT NULL GROUP BY product_ref, product_description) q WHERE rn = 1
    UNION ALL
    SELECT DISTINCT NULL, product_description, NULL, product_description FROM fx_market WHERE (department IN ('ECONOMY', 'STANDARD') OR upper(sub_category) IN ('RING', 'ANVIL')) AND week_start BETWEEN DATE '2001-08-02' - 735 AND DATE '2001-08-02' - 7 AND product_ref IS NULL) c
  ON c.by_ref = s.product_ref OR c.by_text = s.product_description) q
GROUP BY week_start, product_ref, department, category, sub_category, segment, description
