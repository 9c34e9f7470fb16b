SELECT * FROM fx_redemption
