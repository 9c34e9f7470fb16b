SELECT * FROM fx_shelf
