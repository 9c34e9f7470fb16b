SELECT * FROM fx_canonical
