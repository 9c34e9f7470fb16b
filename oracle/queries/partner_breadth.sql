SELECT * FROM fx_breadth
