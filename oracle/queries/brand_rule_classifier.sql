SELECT * FROM fx_classified
