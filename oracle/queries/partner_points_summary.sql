SELECT * FROM fx_points_total
