SELECT * FROM fx_points
