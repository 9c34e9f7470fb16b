SELECT article_id, upper(article_name) AS upper_name, lower(online_brand) AS lower_brand, article_id || ',' || article_name AS joined, replace(online_brand, 'Brand#', '') AS brand_number,
  substr(article_name, 2, 3) AS middle, left(article_name, 3) AS start, CAST(length(article_name) AS INT) AS name_length,
  CASE WHEN article_size < 10 THEN '0' ELSE '' END || CAST(article_size AS VARCHAR) AS padded_size, online_brand AS third_field, article_name LIKE '%ring%' OR article_name LIKE '%rod%' AS ring_or_rod,
  '''' || article_id || '''' AS quoted FROM fx_article
