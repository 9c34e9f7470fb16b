SELECT * FROM fx_calendar
