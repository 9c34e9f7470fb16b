SELECT * FROM fx_config4
