SELECT scv_id, partner_id, SUM(base_points) AS base_points, SUM(bonus_points) AS bonus_points, count(DISTINCT receipt_id) AS transactions, min(txn_date) AS first_date, max(txn_date) AS last_date
FROM fx_partner_txn WHERE source = 'fuel' AND lower(redemption_type) IN ('base', 'bonus') GROUP BY scv_id, partner_id
UNION ALL
SELECT scv_id, partner_id, SUM(base_points), SUM(bonus_points), count(DISTINCT partner_id || '-' || CAST(txn_date AS VARCHAR)), min(txn_date), max(txn_date)
FROM fx_partner_txn WHERE source = 'shop' AND lower(redemption_type) IN ('base', 'bonus') AND NOT behaviour_offer GROUP BY scv_id, partner_id
