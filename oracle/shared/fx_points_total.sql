SELECT scv_id,
  min(first_date) AS member_since,
  max(last_date) AS last_earned,
  sum(transactions)::BIGINT AS transactions,
  sum(base_points) AS base_points,
  sum(bonus_points) AS bonus_points,
  sum(base_points + bonus_points) AS points,
  sum(base_points) FILTER (WHERE partner_id = '2') AS base_points_at_partner,
  sum(bonus_points) FILTER (WHERE partner_id = '2') AS bonus_points_at_partner,
  sum(base_points + bonus_points) FILTER (WHERE partner_id = '2') AS points_at_partner
FROM fx_points
GROUP BY scv_id
