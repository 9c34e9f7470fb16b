SELECT article_id, vendor_code, vendor_description, valid_to FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY valid_to DESC, vendor_code DESC, vendor_description DESC) AS rn
FROM fx_article_site WHERE sales_org = 'ORG2' AND article_id IN (SELECT p.article_id FROM fx_plan p, range(44, 53) w(week) WHERE w.week BETWEEN p.start_week AND p.finish_week)) q WHERE rn = 1
