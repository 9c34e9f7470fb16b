SELECT o.article_id, o.week_start AS own_week, o.department AS own_department, o.segment AS own_segment, o.sales, o.interim_gp, o.manual_claims, o.interim_gp_net, o.quantity,
  m.product_ref, m.week_start AS market_week, m.department AS market_department, m.segment AS market_segment, m.description, m.total_sales, m.total_units, m.competitor_sales, m.competitor_units, m.own_sales, m.own_units, m.franchise_sales, m.franchise_units,
  d.latest_week_order, d.pel_week, d.week_end_date, d.financial_year, d.calendar_year, d.financial_week_start_date, a.price_family_id
FROM fx_own_week o FULL JOIN fx_matched m ON m.product_ref = o.article_id AND m.week_start = o.week_start
LEFT JOIN fx_report_day d ON d.date = coalesce(m.week_start, o.week_start) LEFT JOIN fx_article a ON a.article_id = coalesce(o.article_id, m.product_ref)
