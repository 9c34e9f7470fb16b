WITH valid AS (
  SELECT * FROM (SELECT article_id, site AS store_id, valid_from, valid_to, sell_price,
    row_number() OVER (PARTITION BY article_id, site, valid_from ORDER BY valid_to DESC, sell_price DESC) AS rn FROM fx_price) q WHERE rn = 1)
SELECT l.article_id, l.store_id, l.receipt_id, l.unit_of_measure, l.receipt_date, l.quantity, v.valid_from, v.valid_to, round(v.sell_price, 4) AS sell_price
FROM fx_pos l ASOF LEFT JOIN valid v ON v.article_id = l.article_id AND v.store_id = l.store_id AND v.valid_from <= l.receipt_date
