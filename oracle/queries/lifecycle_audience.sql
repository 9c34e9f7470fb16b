WITH fresh AS (SELECT scv_id FROM fx_customer WHERE customer_status = 'Active' AND is_current AND NOT is_deleted AND is_valid_email AND CAST(created_at AS DATE) + 1 <= DATE '2001-06-02'
-- 13:00 UTC is the next day in New Zealand, in winter and in summer time
  AND scv_id NOT IN (SELECT scv_id FROM fx_partner_txn WHERE source = 'fuel' AND partner_id = '2' AND scv_id IS NOT NULL) AND scv_id IN (SELECT scv_id FROM fx_preference WHERE allow_all AND allow_partner))
SELECT scv_id, 'CAMPAIGN_A' AS campaign_id, 'EXECUTION_A' AS execution_id, ' ' AS segment
FROM (SELECT scv_id FROM fresh UNION SELECT scv_id FROM fx_seed WHERE list_source = 'Partner Seed List' AND partner_id = '1') q
