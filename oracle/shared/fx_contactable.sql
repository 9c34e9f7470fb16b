SELECT DISTINCT c.scv_id FROM fx_customer c JOIN fx_preference p ON p.scv_id = c.scv_id
WHERE c.customer_status = 'Active' AND c.is_current AND NOT c.is_deleted AND c.is_valid_email AND p.allow_all AND p.allow_partner
