SELECT * REPLACE (round(sales, 4) AS sales, round(interim_gp, 4) AS interim_gp, round(manual_claims, 4) AS manual_claims, round(interim_gp_net, 4) AS interim_gp_net) FROM fx_own_week
