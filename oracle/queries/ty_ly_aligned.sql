SELECT * FROM fx_aligned
