SELECT * FROM fx_unsubscribed
