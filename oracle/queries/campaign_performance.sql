SELECT * FROM fx_performance
