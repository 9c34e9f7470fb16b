SELECT * FROM fx_vendor_lists
