SELECT * FROM fx_wholesale
