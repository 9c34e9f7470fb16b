SELECT article_id, CASE WHEN week < 10 THEN '0' ELSE '' END || CAST(week AS VARCHAR) AS week, SUM(ty_purchase) AS ty_purchase, SUM(ly_purchase) AS ly_purchase
FROM (SELECT *, unnest(range(start_week, finish_week + 1)) AS week FROM fx_plan) q GROUP BY ALL
