SELECT article_id, pack_size, unit_of_measure, sell_price AS price, stores FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id, unit_of_measure ORDER BY valid_from DESC, stores DESC, sell_price DESC, pack_size DESC) AS rn FROM (
    SELECT p.article_id, u.pack_size, p.unit_of_measure, p.sell_price, p.valid_from, count(p.sell_price) AS stores
    FROM fx_price p JOIN fx_store t ON t.store_id = p.site JOIN fx_article a ON a.article_id = p.article_id JOIN fx_uom u ON u.article_id = p.article_id AND u.unit_of_measure = p.unit_of_measure
    WHERE t.is_current AND a.is_current AND u.is_current AND p.sales_org = 'ORG2' AND NOT t.is_metro_store AND NOT t.is_neighbourhood_store AND NOT t.is_online_store AND t.store_id <> '27' AND t.store_name NOT LIKE '%Closed%' AND a.category NOT IN ('Brand#5', 'Brand#21')
    GROUP BY ALL) q) r WHERE rn = 1
