SELECT * FROM fx_weekly_segment
