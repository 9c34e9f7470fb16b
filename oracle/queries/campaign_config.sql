SELECT * FROM fx_config
