SELECT * FROM fx_price_list
