SELECT * FROM fx_segment
