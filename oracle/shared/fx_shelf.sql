SELECT article_id, pack_size, unit_of_measure, financial_week_end_date, is_clearance, is_multibuy, is_great_price, price, stores FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY stores DESC, price DESC, unit_of_measure, pack_size, is_clearance, is_multibuy, is_great_price) AS rn FROM (
    SELECT s.article_id, u.pack_size, s.unit_of_measure, s.financial_week_end_date, s.is_clearance, s.is_multibuy, s.is_great_price, s.shelf_price AS price, count(*) AS stores
    FROM fx_store_article s JOIN fx_store t ON t.store_id = s.store_id JOIN fx_uom u ON u.article_id = s.article_id AND u.unit_of_measure = s.unit_of_measure
    WHERE s.is_store_active AND (s.is_new OR s.is_ranged) AND NOT t.is_metro_store AND NOT t.is_neighbourhood_store AND s.financial_week_end_date = DATE '2001-08-05' AND s.category NOT IN ('Brand#5', 'Brand#21')
    GROUP BY ALL) q) r WHERE rn = 1
