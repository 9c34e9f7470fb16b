WITH ty AS (SELECT * FROM fx_scaffold WHERE financial_year = 2001), ly AS (SELECT * FROM fx_scaffold WHERE financial_year = 2000),
j AS (SELECT coalesce(ty.article_id, ly.article_id) AS article_id, coalesce(ty.days_out_ty, ly.days_out_ly) AS days_out, ly.days_out_ly, coalesce(ty.date, ly.date) AS date, coalesce(ty.week, ly.week) AS week,
    coalesce(ty.financial_year, ly.financial_year) AS financial_year, coalesce(ty.pel_week, ly.pel_week) AS pel_week, ty.sales AS ty_sales, ty.quantity AS ty_quantity, ty.interim_gp AS ty_interim_gp,
    ly.sales AS ly_sales, ly.quantity AS ly_quantity, ly.interim_gp AS ly_interim_gp
  FROM ty FULL JOIN ly ON ly.article_id = ty.article_id AND ly.days_out_ly = ty.days_out_ty)
SELECT j.article_id, j.days_out, j.days_out_ly, j.date, j.week, j.financial_year, j.pel_week, round(ty_sales, 4) AS ty_sales, ty_quantity, round(ty_interim_gp, 4) AS ty_interim_gp, round(p.ty_purchase, 4) AS ty_purchase,
  round(ly_sales, 4) AS ly_sales, ly_quantity, round(ly_interim_gp, 4) AS ly_interim_gp, round(p.ly_purchase, 4) AS ly_purchase,
  SUM(CASE WHEN j.financial_year = 2001 THEN ty_quantity END) OVER (PARTITION BY j.article_id, j.financial_year ORDER BY j.date) AS cumulative_ty,
  SUM(ly_quantity) OVER (PARTITION BY j.article_id ORDER BY j.days_out) AS cumulative_ly,
  coalesce((SELECT max(days_out) FROM j WHERE date = DATE '2001-06-14') >= j.days_out AND j.date < DATE '2001-06-15', FALSE) AS is_ty
FROM j JOIN fx_plan_week p ON p.article_id = j.article_id AND p.week = j.week
