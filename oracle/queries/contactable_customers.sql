SELECT * FROM fx_contactable
