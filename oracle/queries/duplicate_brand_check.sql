SELECT article_id, count(brand) AS brands FROM fx_classified GROUP BY article_id HAVING count(brand) > 1
