SELECT * FROM fx_recommended
