SELECT DISTINCT scv_id FROM fx_partner_txn WHERE source = 'fuel' AND partner_id = '2' AND redemption_type = 'cpl discount' AND txn_date BETWEEN DATE '2000-02-01' AND DATE '2000-06-17'
