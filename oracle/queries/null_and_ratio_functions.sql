SELECT nullif(scv_id, '') AS scv_id, round(SUM(CASE WHEN scv_id <> '' THEN quantity END) / nullif(SUM(quantity), 0), 4) AS known_share,
  round(SUM(quantity) / nullif(SUM(CASE WHEN is_online_order THEN quantity ELSE 0 END), 0), 4) AS per_online_unit,
  round((SUM(CASE WHEN is_online_order THEN quantity ELSE 0 END) - SUM(quantity)) / nullif(SUM(quantity), 0), 4) AS change, count(*) FILTER (NOT is_online_order) AS store_lines,
  bool_or(is_online_order_completed) AS any_completed, count(DISTINCT receipt_id) AS receipts FROM fx_line GROUP BY nullif(scv_id, '')
