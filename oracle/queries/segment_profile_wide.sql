SELECT * FROM fx_profile
