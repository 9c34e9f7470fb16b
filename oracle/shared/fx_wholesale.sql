SELECT q.article_id, u.unit_of_measure, d.financial_week_end_date, q.sourcing_dc, q.sourcing_dc_name, CAST(round(CAST(q.cost_price * 1.15 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS wholesale_cost_price, CAST(round(CAST(q.unit_price * 1.15 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS wholesale_unit_price
FROM (SELECT *, cost_charge / multiple_despatched / order_multiple AS cost_price, base_cost / multiple_despatched / order_multiple AS unit_price,
    row_number() OVER (PARTITION BY article_id ORDER BY invoice_date DESC, cost_charge, store_id, cost_charge / multiple_despatched / order_multiple, base_cost / multiple_despatched / order_multiple) AS rn FROM fx_purchase WHERE base_cost <> 0) q
JOIN (SELECT article_id, min(unit_of_measure) AS unit_of_measure FROM fx_uom GROUP BY article_id) u ON u.article_id = q.article_id LEFT JOIN fx_dim_date d ON d.date = q.invoice_date WHERE rn = 1
