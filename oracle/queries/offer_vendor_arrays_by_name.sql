SELECT * FROM fx_vendor_lists WHERE offer_id IN (SELECT offer_id FROM fx_offer WHERE offer_name LIKE 'SKU|%A|x')
