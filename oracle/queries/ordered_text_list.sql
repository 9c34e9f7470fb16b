SELECT department, string_agg(category, ',' ORDER BY category DESC) AS categories FROM (SELECT DISTINCT department, category FROM fx_article) q GROUP BY department
