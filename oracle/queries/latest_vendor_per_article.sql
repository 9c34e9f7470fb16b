SELECT article_id, vendor_code, vendor_description, valid_to FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY valid_to DESC, vendor_code DESC, vendor_description DESC) AS rn FROM fx_article_site WHERE sales_org = 'ORG2') q WHERE rn = 1
