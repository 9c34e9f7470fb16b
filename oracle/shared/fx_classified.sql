SELECT DISTINCT article_id, brand, article_name FROM (
  SELECT *, 'Ringworks' AS brand FROM fx_article WHERE upper(article_name) LIKE '%RING%' AND upper(article_name) NOT LIKE '%OLD%'
  UNION ALL SELECT *, 'Widget & Co' FROM fx_article WHERE (upper(article_name) LIKE '%WIDGET%' OR upper(article_name) LIKE '%GIZMO%' OR (upper(online_brand) = 'BRAND#7' AND upper(article_name) NOT LIKE '%WIDGET%')) AND article_id NOT IN ('7', '70')
  UNION ALL SELECT *, CASE WHEN article_id = '30' THEN 'DISPUTED' ELSE 'Twelve' END FROM fx_article WHERE (online_brand LIKE '%#12%' AND online_brand NOT LIKE '%#125%') OR article_id IN ('3', '30', '300')
  UNION ALL SELECT *, 'Hot Line' FROM fx_article WHERE upper(article_name) LIKE '%HOT %' AND online_brand NOT LIKE '%#1%') q
WHERE article_id IN (SELECT article_id FROM fx_line)
