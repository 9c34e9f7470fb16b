WITH f AS (SELECT b.*, r.last_2m, r.transactions AS pt, r.total_sales AS ps, date_diff('day', r.first_date, r.last_date) / 30 AS pm, date_diff('day', r.last_date, DATE '2001-08-02') AS idle,
    t.transactions AS tt, date_diff('day', t.member_since, t.last_earned) / 30 AS am, c.strategy_segment AS seg, k.cohort, coalesce(s.non_fuel_sales, 0) + coalesce(r.total_sales, 0) AS alls,
    x.scv_id AS ok, u.scv_id AS unsub
  FROM fx_breadth b LEFT JOIN fx_recency r ON r.scv_id = b.scv_id LEFT JOIN fx_points_total t ON t.scv_id = b.scv_id LEFT JOIN fx_customer c ON c.scv_id = b.scv_id
  LEFT JOIN fx_risk k ON k.scv_id = b.scv_id LEFT JOIN fx_reference_sales s ON s.scv_id = b.scv_id LEFT JOIN fx_contactable x ON x.scv_id = b.scv_id LEFT JOIN fx_unsubscribed u ON u.scv_id = b.scv_id),
g AS (SELECT *, pt / nullif(pm, 0) AS v, ps / nullif(pm, 0) AS sp, alls / nullif(am, 0) AS asp, tt / nullif(am, 0) AS av, partner_customer = 1 AS is_p FROM f),
h AS (SELECT *, CASE WHEN is_p AND last_2m = 0 AND seg = 'PROTECT' THEN 1 WHEN is_p AND last_2m = 0 AND seg = 'GROW' THEN 2 WHEN NOT is_p AND seg = 'PROTECT' THEN 3 WHEN NOT is_p AND seg = 'GROW' THEN 4
    WHEN NOT is_p AND asp >= 30000 THEN 5 WHEN (v >= 0.2 AND idle <= 400 AND pt >= 3) OR different_partners >= 7 OR v >= 0.3 OR sp >= 8000 THEN 6 WHEN cohort = 'Risk' AND is_p THEN 7
    WHEN cohort = 'Risk' AND NOT is_p THEN 8 WHEN v >= 0.1 OR sp >= 2000 THEN 9 WHEN NOT is_p AND (av >= 0.4 OR asp > 9000) THEN 10 WHEN is_p THEN 11 ELSE 12 END AS rule FROM g)
SELECT scv_id, CASE WHEN is_p THEN 'Partner customer' ELSE 'Non partner customer' END AS partner_status,
  CASE rule WHEN 1 THEN 'Lapsed partner customer - loyal' WHEN 2 THEN 'Lapsed partner customer - cross-shopper' WHEN 3 THEN 'Non partner customer - loyal' WHEN 4 THEN 'Non partner customer - cross-shopper'
    WHEN 5 THEN 'Non partner customer - high volume' WHEN 6 THEN 'Already engaged' WHEN 7 THEN 'Infrequent partner customer - at risk' WHEN 8 THEN 'Non partner customer - at risk'
    WHEN 9 THEN 'Infrequent partner customer - mid volume' WHEN 10 THEN 'Non partner customer - mid volume' WHEN 11 THEN 'Infrequent partner customer - low engagement' ELSE 'Non partner customer - low engagement' END AS segment,
  CASE WHEN rule IN (1, 2, 8) THEN 'Re-engage' WHEN rule IN (3, 4, 5, 10, 12) THEN 'Win' WHEN rule = 6 THEN 'Protect' ELSE 'Grow' END AS treatment,
  CASE WHEN ok IS NULL THEN 'Non contactable' ELSE 'Contactable' END AS contactability, CAST(CASE WHEN unsub IS NULL THEN 0 ELSE 1 END AS INT) AS unsubscribed FROM h
