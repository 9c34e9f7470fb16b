SELECT market, department, category, sub_category, segment, CAST(grouping(market, department, category, sub_category, segment) AS BIGINT) AS grouping_id,
  round(SUM(value_excl_tax), 4) AS sales, SUM(units) AS units, count(value_excl_tax) AS lines, min(week_start) AS first_week, max(week_start) AS last_week
FROM fx_market
GROUP BY GROUPING SETS ((market, department, category, sub_category, segment), (market, department, category, sub_category), (market, department, category), (market, department), (market))
