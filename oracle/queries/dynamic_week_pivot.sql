SELECT s.article_id,
  round(SUM(CASE WHEN week = 200204 THEN sales END), 4) AS "200204",
  round(SUM(CASE WHEN week = 200203 THEN sales END), 4) AS "200203",
  round(SUM(CASE WHEN week = 200202 THEN sales END), 4) AS "200202",
  round(SUM(CASE WHEN week = 200201 THEN sales END), 4) AS "200201",
  round(SUM(CASE WHEN week = 200152 THEN sales END), 4) AS "200152",
  round(SUM(CASE WHEN week = 200151 THEN sales END), 4) AS "200151",
  round(SUM(CASE WHEN week = 200150 THEN sales END), 4) AS "200150",
  round(SUM(CASE WHEN week = 200149 THEN sales END), 4) AS "200149",
  round(SUM(CASE WHEN week = 200148 THEN sales END), 4) AS "200148",
  round(SUM(CASE WHEN week = 200147 THEN sales END), 4) AS "200147",
  round(SUM(CASE WHEN week = 200146 THEN sales END), 4) AS "200146",
  round(SUM(CASE WHEN week = 200145 THEN sales END), 4) AS "200145",
  round(SUM(CASE WHEN week = 200144 THEN sales END), 4) AS "200144",
  round(SUM(CASE WHEN week = 200143 THEN sales END), 4) AS "200143",
  round(SUM(CASE WHEN week = 200142 THEN sales END), 4) AS "200142",
  round(SUM(CASE WHEN week = 200141 THEN sales END), 4) AS "200141",
  round(SUM(CASE WHEN week = 200140 THEN sales END), 4) AS "200140",
  round(SUM(CASE WHEN week = 200139 THEN sales END), 4) AS "200139",
  round(SUM(CASE WHEN week = 200138 THEN sales END), 4) AS "200138",
  round(SUM(CASE WHEN week = 200137 THEN sales END), 4) AS "200137",
  round(SUM(CASE WHEN week = 200136 THEN sales END), 4) AS "200136",
  round(SUM(CASE WHEN week = 200135 THEN sales END), 4) AS "200135",
  round(SUM(CASE WHEN week = 200134 THEN sales END), 4) AS "200134",
  round(SUM(CASE WHEN week = 200133 THEN sales END), 4) AS "200133",
  round(SUM(CASE WHEN week = 200132 THEN sales END), 4) AS "200132",
  round(SUM(CASE WHEN week = 200131 THEN sales END), 4) AS "200131",
  round(SUM(CASE WHEN week = 200130 THEN sales END), 4) AS "200130",
  round(SUM(CASE WHEN week = 200129 THEN sales END), 4) AS "200129",
  round(SUM(CASE WHEN week = 200128 THEN sales END), 4) AS "200128",
  round(SUM(CASE WHEN week = 200127 THEN sales END), 4) AS "200127",
  round(SUM(CASE WHEN week = 200126 THEN sales END), 4) AS "200126",
  round(SUM(CASE WHEN week = 200125 THEN sales END), 4) AS "200125",
  round(SUM(CASE WHEN week = 200124 THEN sales END), 4) AS "200124",
  round(SUM(CASE WHEN week = 200123 THEN sales END), 4) AS "200123",
  round(SUM(CASE WHEN week = 200122 THEN sales END), 4) AS "200122",
  round(SUM(CASE WHEN week = 200121 THEN sales END), 4) AS "200121",
  round(SUM(CASE WHEN week = 200120 THEN sales END), 4) AS "200120",
  round(SUM(CASE WHEN week = 200119 THEN sales END), 4) AS "200119",
  round(SUM(CASE WHEN week = 200118 THEN sales END), 4) AS "200118",
  round(SUM(CASE WHEN week = 200117 THEN sales END), 4) AS "200117",
  round(SUM(CASE WHEN week = 200116 THEN sales END), 4) AS "200116",
  round(SUM(CASE WHEN week = 200115 THEN sales END), 4) AS "200115",
  round(SUM(CASE WHEN week = 200114 THEN sales END), 4) AS "200114",
  round(SUM(CASE WHEN week = 200113 THEN sales END), 4) AS "200113",
  round(SUM(CASE WHEN week = 200112 THEN sales END), 4) AS "200112",
  round(SUM(CASE WHEN week = 200111 THEN sales END), 4) AS "200111",
  round(SUM(CASE WHEN week = 200110 THEN sales END), 4) AS "200110",
  round(SUM(CASE WHEN week = 200109 THEN sales END), 4) AS "200109",
  round(SUM(CASE WHEN week = 200108 THEN sales END), 4) AS "200108",
  round(SUM(CASE WHEN week = 200107 THEN sales END), 4) AS "200107",
  round(SUM(CASE WHEN week = 200106 THEN sales END), 4) AS "200106",
  round(SUM(CASE WHEN week = 200105 THEN sales END), 4) AS "200105"
FROM (SELECT article_id, financial_week_end_date, SUM(weekly_sales) AS sales FROM fx_store_article WHERE category = 'Brand#3' GROUP BY ALL) s
JOIN (SELECT financial_week_end_date, arg_min(financial_period_week, date) AS week FROM fx_dim_date GROUP BY ALL) d ON d.financial_week_end_date = s.financial_week_end_date
WHERE s.financial_week_end_date BETWEEN DATE '2001-07-29' - 357 AND DATE '2001-07-29' GROUP BY s.article_id
