SELECT * FROM fx_standard
