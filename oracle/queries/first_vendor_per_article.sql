SELECT article_id, vendor_code, vendor_description FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY vendor_code, vendor_description) AS rn FROM fx_article_site WHERE sales_org = 'ORG2') q WHERE rn = 1
