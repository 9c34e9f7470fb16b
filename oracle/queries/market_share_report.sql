WITH i AS (SELECT pel_week, week_end_date, upper(coalesce(market_department, own_department)) AS department_combined, upper(coalesce(market_segment, own_segment)) AS segment_combined, latest_week_order,
    SUM(total_sales) AS total_sales, SUM(competitor_sales) AS competitor_sales, SUM(own_sales) AS own_sales, SUM(franchise_sales) AS franchise_sales, SUM(own_units) AS own_units FROM fx_combined GROUP BY ALL),
c AS (SELECT d.pel_week, d.week_end_date, upper(p.department) AS department_combined, upper(p.segment) AS segment_combined, d.latest_week_order, SUM(sales) AS sales, SUM(interim_gp) AS interim_gp,
    SUM(interim_gp - manual_claims) AS interim_gp_net FROM fx_profit p LEFT JOIN fx_report_day d ON d.date = p.calendar_day
  WHERE p.sales_org = 'ORG2' AND p.article_id NOT LIKE 'Z%' AND CAST(date_trunc('week', p.calendar_day) AS DATE) BETWEEN DATE '2001-08-02' - 728 AND DATE '2001-08-02' - 7 GROUP BY ALL)
SELECT coalesce(i.pel_week, c.pel_week) AS pel_week, coalesce(i.week_end_date, c.week_end_date) AS week_end_date, coalesce(i.department_combined, c.department_combined) AS department_combined,
  coalesce(i.segment_combined, c.segment_combined) AS segment_combined, coalesce(i.latest_week_order, c.latest_week_order) AS latest_week_order, round(c.sales, 4) AS sales, round(c.interim_gp, 4) AS interim_gp,
  round(c.interim_gp_net, 4) AS interim_gp_net, round(i.total_sales, 4) AS total_sales, round(i.competitor_sales, 4) AS competitor_sales, round(i.own_sales, 4) AS own_sales, round(i.franchise_sales, 4) AS franchise_sales, i.own_units, '' AS category_manager, '' AS merchandise_manager, DATE '2001-08-02' AS refresh_date
FROM i FULL JOIN c ON c.week_end_date = i.week_end_date AND c.department_combined = i.department_combined AND c.segment_combined = i.segment_combined
