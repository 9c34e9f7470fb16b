SELECT * FROM fx_retention
