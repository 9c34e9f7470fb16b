SELECT article_id, week, round(ty_purchase, 4) AS ty_purchase, round(ly_purchase, 4) AS ly_purchase FROM fx_plan_week
