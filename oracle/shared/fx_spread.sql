SELECT week_start, product_ref, segment, department, product_description,
  SUM(CASE WHEN market = 'Total' THEN value_excl_tax ELSE 0 END) AS total_sales, SUM(CASE WHEN market = 'Total' THEN units ELSE 0 END) AS total_units, SUM(CASE WHEN market = 'Competitor' THEN value_excl_tax ELSE 0 END) AS competitor_sales, SUM(CASE WHEN market = 'Competitor' THEN units ELSE 0 END) AS competitor_units, SUM(CASE WHEN market = 'Own' THEN value_excl_tax ELSE 0 END) AS own_sales, SUM(CASE WHEN market = 'Own' THEN units ELSE 0 END) AS own_units, SUM(CASE WHEN market = 'Franchise' THEN value_excl_tax ELSE 0 END) AS franchise_sales, SUM(CASE WHEN market = 'Franchise' THEN units ELSE 0 END) AS franchise_units
FROM fx_market WHERE (department IN ('ECONOMY', 'STANDARD', 'PROMO', 'LARGE') OR segment IN ('Brand#3', 'Brand#11')) AND week_start BETWEEN DATE '2001-08-02' - 728 AND DATE '2001-08-02' - 7 GROUP BY ALL
