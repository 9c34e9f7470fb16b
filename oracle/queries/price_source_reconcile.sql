SELECT coalesce(a.article_id, b.article_id) AS article_id, coalesce(a.unit_of_measure, b.unit_of_measure) AS unit_of_measure, coalesce(a.pack_size, b.pack_size) AS pack_size,
  a.price AS price_a, b.price AS price_b, a.stores AS stores_a, b.stores AS stores_b,
  CASE WHEN a.article_id IS NULL THEN 'missing in a' WHEN b.article_id IS NULL THEN 'missing in b' WHEN a.price <> b.price THEN 'price mismatch' WHEN a.stores <> b.stores THEN 'count mismatch' ELSE 'match' END AS difference
FROM fx_standard a FULL JOIN fx_recommended b ON b.article_id = a.article_id AND b.unit_of_measure = a.unit_of_measure
