SELECT t.*, a.article_name, a.department, a.category, a.sub_category, a.segment, v.vendor_description
FROM fx_aligned t JOIN fx_article a ON a.article_id = t.article_id
LEFT JOIN (SELECT article_id, vendor_description, row_number() OVER (PARTITION BY article_id ORDER BY vendor_code, vendor_description) AS rn FROM fx_article_site WHERE sales_org = 'ORG2') v
  ON v.article_id = t.article_id AND v.rn = 1
